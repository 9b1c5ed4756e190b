"""Distance, nearness and containment joins through grid cells.

A point is hashed to a square cell; the other side is repeated for the cells that it can reach, so
every join is an equality join on cells followed by the exact test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penumbra.functions import geo


def _cells(df: DataFrame, x0: Column, x1: Column, y0: Column, y1: Column, size: float) -> DataFrame:
    """A row for every cell that the box meets."""
    return df.withColumn("_cx", F.explode(F.sequence(geo.grid_cell(x0, size), geo.grid_cell(x1, size)))).withColumn(
        "_cy", F.explode(F.sequence(geo.grid_cell(y0, size), geo.grid_cell(y1, size)))
    )


def _on_sphere(lon: Column, lat: Column) -> list[Column]:
    """A point's place in space, in metres from the earth's middle."""
    r, phi, lam = F.lit(geo.EARTH_RADIUS_M), F.radians(lat), F.radians(lon)
    return [r * F.cos(phi) * F.cos(lam), r * F.cos(phi) * F.sin(lam), r * F.sin(phi)]


#: Rows of one place that lie in one array, so that no array grows with a hot place.
_PACK = 4096


def _packed(df: DataFrame, key: list[str], name: str) -> DataFrame:
    """Different ``key`` values with the other columns of their rows as arrays ``name``, of 4,096 rows at most each."""
    place = F.floor((F.row_number().over(Window.partitionBy(*key).orderBy(*key)) - 1) / _PACK)
    rest = F.struct(*(c for c in df.columns if c not in key)) if len(df.columns) > len(key) else F.struct(F.lit(True).alias("_one"))
    numbered = df.withColumn("_pack", place)
    return numbered.groupBy(*key, "_pack").agg(F.collect_list(rest).alias(name)).drop("_pack")


def spread(df: DataFrame, key: list[str]) -> DataFrame:
    """``df`` over all shuffle partitions by ``key``: few bytes here are much work, so partitions mustn't be joined by their size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def _unpacked(met: DataFrame, left: DataFrame, key: list[str], name: str, right_columns: list[str], more: list[str]) -> DataFrame:
    """Rows of ``left`` with all rows of the arrays that their ``key`` has met: nothing is tested or shuffled a pair of rows."""
    pairs = left.join(spread(met, key), key).select(*left.columns, *more, F.explode(name).alias("_row"))
    return pairs.select(*left.columns, *(c if c in more else F.col(f"_row.{c}").alias(c) for c in right_columns), *(c for c in more if c not in right_columns))


def radius_join(left: DataFrame, right: DataFrame, metres: float, digits: int | None = None) -> DataFrame:
    """All pairs of points at most ``metres`` apart, with ``metres``, rounded to ``digits`` if given.

    Both sides have ``lon`` and ``lat`` and otherwise distinct columns; the right side's become ``right_lon`` and ``right_lat``.
    Cells are cubes in space of twice the distance, so poles and the date line need no care: a right point is repeated for the
    cubes, eight at most, that its surroundings meet. Places meet once, however many points share them; then each left point gets
    the points of the places that its own has met.
    """
    reach = metres * 1.01 + 1e-3
    size = reach * 2
    names = ["_cx", "_cy", "_cz"]
    at = left.select("lon", "lat").distinct()
    one = at.select("*", *(geo.grid_cell(v, size).alias(n) for v, n in zip(_on_sphere(F.col("lon"), F.col("lat")), names, strict=True)))
    renamed = right.withColumnRenamed("lon", "right_lon").withColumnRenamed("lat", "right_lat")
    two = _packed(renamed, ["right_lon", "right_lat"], "_rows")
    for v, n in zip(_on_sphere(F.col("right_lon"), F.col("right_lat")), names, strict=True):
        two = two.withColumn(n, F.explode(F.sequence(geo.grid_cell(v - reach, size), geo.grid_cell(v + reach, size))))
    away = geo.haversine(F.col("lon"), F.col("lat"), F.col("right_lon"), F.col("right_lat"))
    met = spread(one, names).join(spread(two, names), names).drop(*names).withColumn("metres", away).where(F.col("metres") <= metres)
    if digits is not None:
        met = met.withColumn("metres", F.round("metres", digits))  # once two places, not once a pair
    return _unpacked(met, left, ["lon", "lat"], "_rows", renamed.columns, ["right_lon", "right_lat", "metres"])


def nearest_few(left: DataFrame, right: DataFrame, left_id: str, right_id: str, count: int, metres: float, keep: list[str] | None = None) -> DataFrame:
    """``(left_id), near``: of every left point with right points within ``metres`` the ``count`` nearest as ``metres, (right_id)`` and the right columns in
    ``keep``, ties to the smaller id.

    A left point goes to its cube in space, where it meets the right points around as arrays (of 4,096 at most), so only the nearest of each
    array are shuffled by left point, not all pairs.
    """
    reach = metres * 1.01 + 1e-3
    size = reach  # small cubes: every left point is held against all that its cube's arrays have
    names, axes = ["_cx", "_cy", "_cz"], ["_x", "_y", "_z"]
    keep = keep or []
    placed = lambda df, *columns: df.select(*columns, "lon", "lat", *(v.alias(a) for v, a in zip(_on_sphere(F.col("lon"), F.col("lat")), axes, strict=True)))
    one, two = placed(left, left_id), placed(right, right_id, *keep)
    for n, v in zip(names, map(F.col, axes), strict=True):
        one = one.withColumn(n, geo.grid_cell(v, size))
        two = two.withColumn(n, F.explode(F.sequence(geo.grid_cell(v - reach, size), geo.grid_cell(v + reach, size))))
    # What the cubes repeat isn't in the size that a plan expects, so the arrays must not be sent to all through the driver.
    met = spread(one, names).join(_packed(two, names, "_rows").hint("merge"), names)
    # The straight way through the earth is no longer than the arc, and cheaper to tell.
    square = lambda v: v * v
    close = F.filter("_rows", lambda r: square(r["_x"] - F.col("_x")) + square(r["_y"] - F.col("_y")) + square(r["_z"] - F.col("_z")) <= reach * reach)
    away = F.transform(close, lambda r: F.struct(geo.haversine(F.col("lon"), F.col("lat"), r["lon"], r["lat"]).alias("metres"), *(r[c].alias(c) for c in (right_id, *keep))))
    first = lambda a: F.slice(F.sort_array(a), 1, count)
    near = met.select(left_id, F.explode(F.array(first(F.filter(away, lambda m: m["metres"] <= metres)))).alias("_near")).where(F.size("_near") > 0)
    return near.groupBy(left_id).agg(first(F.flatten(F.collect_list("_near"))).alias("near"))


def nearest_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, metres: float) -> DataFrame:
    """The nearest right point within ``metres`` of every left point, ties to the smaller id; exact up to the cap."""
    # Points of one place have one nearest, and of right points of one place the smallest id stands for all.
    at, to = left.select("lon", "lat").distinct(), right.groupBy("lon", "lat").agg(F.min(F.struct(right_id)).alias("_to"))
    near = radius_join(at, to, metres).groupBy("lon", "lat").agg(F.min(F.struct("metres", F.col(f"_to.{right_id}").alias(right_id))).alias("b"))
    best = left.select(left_id, "lon", "lat").join(near, ["lon", "lat"]).groupBy(left_id).agg(F.min("b").alias("b"))
    return best.select(left_id, F.col(f"b.{right_id}").alias(right_id), F.col("b.metres").alias("metres"))


def nearest_segment(points: DataFrame, segments: DataFrame, point_id: str, segment_id: str, cap: float) -> DataFrame:
    """The nearest segment within ``cap`` of every point in plane coordinates: id, share along it and distance.

    ``points`` has ``x, y``; ``segments`` has ``ax, ay, bx, by``. Ties go to the smaller id.
    """
    size = max(cap * 2, 1e-9)
    boxes = _cells(
        segments,
        F.least("ax", "bx") - cap,
        F.greatest("ax", "bx") + cap,
        F.least("ay", "by") - cap,
        F.greatest("ay", "by") + cap,
        size,
    )
    probes = points.withColumn("_cx", geo.grid_cell(F.col("x"), size)).withColumn("_cy", geo.grid_cell(F.col("y"), size))
    t, away = geo.project_on_segment(*map(F.col, ("x", "y", "ax", "ay", "bx", "by")))
    best = F.min(F.struct(away.alias("distance"), F.col(segment_id).alias("id"), t.alias("t")))
    return (
        probes.join(boxes, ["_cx", "_cy"])
        .where(away <= cap)
        .groupBy(point_id)
        .agg(best.alias("b"))
        .select(point_id, F.col("b.id").alias(segment_id), F.col("b.t").alias("t"), F.col("b.distance").alias("distance"))
    )


def within_rings(points: DataFrame, shapes: DataFrame, size: float) -> DataFrame:
    """Pairs of points ``x, y`` and shapes whose ``ring`` (array of {x, y}) holds them. Places and rings meet once, however many share them."""
    xs, ys = F.col("ring.x"), F.col("ring.y")
    boxes = _cells(_packed(shapes, ["ring"], "_rows"), F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys), size)
    places = points.select("x", "y").distinct()
    probes = places.withColumn("_cx", geo.grid_cell(F.col("x"), size)).withColumn("_cy", geo.grid_cell(F.col("y"), size))
    met = spread(probes, ["_cx", "_cy"]).join(spread(boxes, ["_cx", "_cy"]), ["_cx", "_cy"]).where(geo.point_in_ring(F.col("x"), F.col("y"), F.col("ring"))).drop("_cx", "_cy")
    return _unpacked(met, points, ["x", "y"], "_rows", shapes.columns, ["ring"])


def box_join(queries: DataFrame, shards: DataFrame, size: float) -> DataFrame:
    """Pairs of boxes that meet. Both sides have ``south, west, north, east``; the right side's get the prefix ``shard_``.

    Boxes meet in the cells that both cover; of these only the lowest common one gives the pair. Equal boxes meet once, however many there are.
    """
    names = ["south", "west", "north", "east"]
    right = shards.withColumnsRenamed({n: f"shard_{n}" for n in names})
    a = _cells(queries.select(*names).distinct(), F.col("west"), F.col("east"), F.col("south"), F.col("north"), size)
    b = _packed(right, [f"shard_{n}" for n in names], "_rows")
    b = _cells(b, F.col("shard_west"), F.col("shard_east"), F.col("shard_south"), F.col("shard_north"), size)
    first = (F.col("_cx") == geo.grid_cell(F.greatest("west", "shard_west"), size)) & (
        F.col("_cy") == geo.grid_cell(F.greatest("south", "shard_south"), size)
    )
    meet = geo.boxes_meet([F.col(n) for n in names], [F.col(f"shard_{n}") for n in names])
    met = spread(a, ["_cx", "_cy"]).join(spread(b, ["_cx", "_cy"]), ["_cx", "_cy"]).where(first & meet).drop("_cx", "_cy")
    return _unpacked(met, queries, names, "_rows", right.columns, [f"shard_{n}" for n in names])


def tile_shards(edges: DataFrame, zoom: int) -> DataFrame:
    """Edges with the tile of their midpoint and whether an end lies in another tile (a seam).

    ``edges`` has ``from_lon, from_lat, to_lon, to_lat``.
    """
    mid = [(F.col("from_lon") + F.col("to_lon")) / 2, (F.col("from_lat") + F.col("to_lat")) / 2]
    own = edges.withColumn("tile_x", geo.tile_x(mid[0], zoom)).withColumn("tile_y", geo.tile_y(mid[1], zoom))
    seam = F.lit(False)
    for end in ("from", "to"):
        x, y = geo.tile_x(F.col(f"{end}_lon"), zoom), geo.tile_y(F.col(f"{end}_lat"), zoom)
        seam = seam | (x != F.col("tile_x")) | (y != F.col("tile_y"))
    return own.withColumn("seam", seam)


def halo(cells: DataFrame, reach: int = 1) -> DataFrame:
    """Every cell ``x, y`` with its neighbours ``near_x, near_y`` up to ``reach`` away."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    return (
        cells.withColumn("_dx", F.explode(steps))
        .withColumn("_dy", F.explode(steps))
        .withColumn("near_x", F.col("x") + F.col("_dx"))
        .withColumn("near_y", F.col("y") + F.col("_dy"))
        .drop("_dx", "_dy")
    )


def quadtree_levels(leaves: DataFrame, zoom: int, top: int) -> DataFrame:
    """Minimum, maximum and coverage of tiles from ``zoom`` up to ``top``.

    ``leaves`` has ``x, y, low, high, coverage``. A parent whose four children aren't all there has
    coverage 2 (unknown), otherwise the highest of its children's. All levels come from one pass: a
    leaf is counted for each ancestor, and full subtrees have 4**depth leaves.
    """
    depth = F.explode(F.sequence(F.lit(0), F.lit(zoom - top))).alias("depth")
    up = leaves.select("*", depth)
    up = up.withColumn("px", F.expr("shiftright(x, depth)")).withColumn("py", F.expr("shiftright(y, depth)"))
    full = F.count("*") == F.pow(F.lit(4), F.first("depth")).cast("long")
    return up.groupBy("depth", "px", "py").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.when(full, F.max("coverage")).otherwise(F.lit(2)).cast("int").alias("coverage")
    ).select((F.lit(zoom) - F.col("depth")).alias("zoom"), F.col("px").alias("x"), F.col("py").alias("y"), "low", "high", "coverage")


def interchange_pairs(stops: DataFrame, metres: float) -> DataFrame:
    """Pairs of stops of one name (any case) less than ``metres`` apart, each pair once; stops meet by place and name, so a name that
    many stops share is no hot key."""
    side = lambda n: stops.select(F.lower("name").alias(f"_{n}"), F.col("stop_id").alias(n), "lon", "lat")
    pairs = radius_join(side("a"), side("b"), metres).where((F.col("_a") == F.col("_b")) & (F.col("a") < F.col("b")))
    return pairs.where(F.col("metres") < metres).select("a", "b", "metres")


def rank_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
