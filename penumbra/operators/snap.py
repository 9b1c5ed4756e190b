"""Points snapped to street edges, edges split at them, and stops brought into one component."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penumbra.functions import geo
from penumbra.operators.graph import components
from penumbra.session import cut

_ENDS = ["from_lon", "from_lat", "to_lon", "to_lat"]
#: More edges than one cell holds; times a cap in micrometres it fits 64 bits.
_PLACES = 1 << 24


def nearest_edge(points: DataFrame, edges: DataFrame, point_id: str, cap: float, same: list[str] | None = None) -> DataFrame:
    """The edge nearest to each point within ``cap`` metres: ``(point_id, edge_id, from_id, to_id, t, distance)``.

    ``points`` has ``lon, lat``; ``edges`` has ``edge_id, from_id, to_id`` and its ends' coordinates. A point is projected on an edge
    in degrees and the distance taken along the great circle; distances equal to a micrometre tie to the smaller edge. Columns in
    ``same`` must be equal on both sides. Points without an edge that near, or without coordinates, are left out. Edges are repeated
    for the cells that their box, grown by the cap at their own latitude, meets; points lie in one cell each. Cells are wider in degrees towards the
    poles. Edges across the date line must be cut there.
    """
    same = same or []
    dlat = cap / geo.METRES_PER_DEGREE * 1.01
    low, high = F.least("from_lat", "to_lat") - dlat, F.greatest("from_lat", "to_lat") + dlat
    # Degrees of longitude are shortest at the end nearer to a pole; around a pole itself all are near.
    away = lambda lat: F.abs(F.cos(F.radians(lat)))
    pole = F.floor((high - 90) / 180) != F.floor((low - 90) / 180)
    dlon = F.when(pole, F.lit(180.0)).otherwise(F.least(F.lit(dlat) / F.greatest(F.least(away(low), away(high)), F.lit(1e-12)), F.lit(180.0)))
    size = dlat * 2
    # Cells of one row are as wide in metres as high, so an edge meets a few of them at any latitude.
    width = F.lit(size) / F.greatest(away((F.col("_cy") + 0.5) * size), F.lit(1e-3))
    box = [F.least("from_lon", "to_lon") - dlon, F.greatest("from_lon", "to_lon") + dlon, low, high]
    laid = edges.select("edge_id", "from_id", "to_id", *_ENDS, *same, *(c.alias(n) for c, n in zip(box, ("_x0", "_x1", "_y0", "_y1"), strict=True)))
    cell_x = lambda c: F.floor(F.col(c) / width).cast("long")
    laid = laid.withColumn("_cy", F.explode(F.sequence(geo.grid_cell(F.col("_y0"), size), geo.grid_cell(F.col("_y1"), size))))
    laid = laid.withColumn("_cx", F.explode(F.sequence(cell_x("_x0"), cell_x("_x1"))))
    probes = points.select(point_id, "lon", "lat", *same).withColumn("_cy", geo.grid_cell(F.col("lat"), size)).withColumn("_cx", cell_x("lon"))
    near = F.col("lon").between(F.col("_x0"), F.col("_x1")) & F.col("lat").between(F.col("_y0"), F.col("_y1"))
    t, _ = geo.project_on_segment(F.col("lon"), F.col("lat"), *map(F.col, _ENDS))
    x = F.col("from_lon") + F.col("t") * (F.col("to_lon") - F.col("from_lon"))
    y = F.col("from_lat") + F.col("t") * (F.col("to_lat") - F.col("from_lat"))
    # Arrays of one element, exploded, keep what is computed once from being computed in every place of its use.
    # A point's edges are all in its one cell, so their place there, in order of their ids, breaks ties in a number that holds the distance
    # too. The least of such numbers needs no sort of the pairs, and a point stays in the task of its cell.
    cell = ["_cx", "_cy", *same]
    placed = laid.withColumn("_place", F.row_number().over(Window.partitionBy(*cell).orderBy("edge_id", "from_id", "to_id")))
    pairs = probes.join(placed, cell).where(near).withColumn("t", F.explode(F.array(t)))
    pairs = pairs.withColumn("distance", F.explode(F.array(geo.haversine(F.col("lon"), F.col("lat"), x, y)))).where(F.col("distance") <= cap)
    rank = F.floor(F.col("distance") * 1e6 + 0.5).cast("long") * _PLACES + F.col("_place")
    first = pairs.groupBy(point_id, "lon", "lat", *cell).agg(F.min(rank).alias("_first")).withColumn("_place", (F.col("_first") % _PLACES).cast("int"))
    # A point given twice takes the nearer edge.
    met = first.join(placed.drop("_x0", "_x1", "_y0", "_y1"), [*cell, "_place"]).withColumn("t", t)
    met = met.withColumn("distance", geo.haversine(F.col("lon"), F.col("lat"), x, y))
    best = met.groupBy(point_id).agg(F.min(F.struct(F.round("distance", 6), "edge_id", "from_id", "to_id", "t", "distance")).alias("b"))
    return best.select(point_id, *(F.col(f"b.{c}").alias(c) for c in ("edge_id", "from_id", "to_id", "t", "distance")))


def snapped_node(point_id: str):
    """The node of a snapped point: an end of its edge, or a virtual node ``-1 - point_id`` inside it."""
    return F.when(F.col("t") == 0, F.col("from_id")).when(F.col("t") == 1, F.col("to_id")).otherwise(-1 - F.col(point_id))


def split_edges(snaps: DataFrame, edges: DataFrame, point_id: str) -> DataFrame:
    """The edges that join the virtual nodes of ``snaps`` (as ``nearest_edge`` gives) to both ends of their edge, both ways.

    Metres are shares of the whole edge's; other columns of ``edges`` are handed on. The split edges themselves stay, and two
    points on one edge aren't joined with each other. Points at an end need no new edge.
    """
    inside = snaps.where((F.col("t") > 0) & (F.col("t") < 1)).select("edge_id", "t", (-1 - F.col(point_id)).alias("_v"))
    held = edges.join(inside, "edge_id").withColumn("_m", geo.haversine(*map(F.col, _ENDS)))
    rest = [c for c in edges.columns if c not in ("from_id", "to_id", "metres", *_ENDS)]
    near, far = F.col("_m") * F.col("t"), F.col("_m") * (1 - F.col("t"))
    ways = [("_v", "from_id", near), ("_v", "to_id", far), ("from_id", "_v", near), ("to_id", "_v", far)]
    four = F.explode(F.array(*(F.struct(F.col(a).alias("a"), F.col(b).alias("b"), m.alias("m")) for a, b, m in ways)))
    return held.select(*rest, four.alias("_e")).select(F.col("_e.a").alias("from_id"), F.col("_e.b").alias("to_id"), F.col("_e.m").alias("metres"), *rest)


def snap_stops(stops: DataFrame, edges: DataFrame, route: str, sequence: str, cap: float = 100.0, reach: float = 1000.0) -> DataFrame:
    """Stops of routes snapped into one component each: the stop's route and sequence, ``edge_id, t, distance`` and ``status``.

    A route takes the largest component (by crossings) that the nearest edge of any of its stops lies in, equal ones by the later
    stop. Stops of other components move to the nearest edge of that one: ``moved``, or ``too_far`` beyond ``cap``; stops without
    any edge within ``reach`` are ``no_street``. Of repeated stops of a route and sequence the one with the smallest other columns is kept.
    """
    member = cut(components(edges).select(F.col("node").alias("from_id"), "component"))
    sizes = member.groupBy("component").agg(F.count("*").alias("size"))
    laid = cut(edges.join(member, "from_id"))
    key = [route, sequence]
    rest = [c for c in stops.columns if c not in key]
    ids = stops.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_s")).select(*key, *(F.col(f"_s.{c}").alias(c) for c in rest)).withColumn("_stop", F.struct(*key))
    first = cut(nearest_edge(ids, laid, "_stop", reach).join(member, "from_id").join(sizes, "component"))
    target = first.groupBy(F.col(f"_stop.{route}").alias(route)).agg(F.max(F.struct("size", F.col(f"_stop.{sequence}").alias("_at"), "component"))["component"].alias("target"))
    placed = first.join(target, F.col(f"_stop.{route}") == F.col(route)).select("_stop", "component", "target", "edge_id", "t", "distance")
    stay = placed.where("component = target").select("_stop", "edge_id", "t", "distance", F.lit("kept").alias("status"))
    lost = placed.where("component <> target").select("_stop", F.col("target").alias("component")).join(ids, "_stop")
    found = cut(nearest_edge(lost, laid, "_stop", cap, ["component"]).select("_stop", "edge_id", "t", "distance", F.lit("moved").alias("status")))
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema.fields if f.name in ("edge_id", "t", "distance")]
    far = lost.join(found, "_stop", "left_anti").select("_stop", *none, F.lit("too_far").alias("status"))
    off = ids.join(first, "_stop", "left_anti").select("_stop", *none, F.lit("no_street").alias("status"))
    return reduce(DataFrame.union, (stay, found, far, off)).select(F.col(f"_stop.{route}"), F.col(f"_stop.{sequence}"), "edge_id", "t", "distance", "status")


def stay_exposure(stays: DataFrame, edges: DataFrame, bucket_seconds: float, buckets: int) -> DataFrame:
    """Pieces of standing at a node, one a bucket of time: ``(stay_id, bucket, seconds, shade)``.

    ``stays`` has ``stay_id, node, start, seconds``; ``edges`` has ``from_id, shade, series``. The shade of a piece is that of the
    shadiest edge leaving the node in its bucket (the last value after a series' end, the static one without a series); a node
    without edges has none. The last bucket has no end; stays of no length have no pieces.
    """
    by_bucket = edges.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    value = F.when(F.coalesce(F.size("series"), F.lit(0)) > 0, F.element_at("series", F.greatest(F.least(F.col("bucket") + 1, F.size("series")), F.lit(1)))).otherwise(F.col("shade"))
    best = by_bucket.groupBy(F.col("from_id").alias("node"), "bucket").agg(F.greatest(F.max(value), F.lit(0.0)).alias("shade"))
    end = F.col("start") + F.col("seconds")
    at = lambda c: F.least(F.floor(c / bucket_seconds), F.lit(buckets - 1)).cast("int")
    pieces = stays.where(F.col("seconds") > 0).withColumn("bucket", F.explode(F.sequence(at(F.col("start")), at(end))))
    until = F.when(F.col("bucket") < buckets - 1, F.least(end, (F.col("bucket") + 1) * bucket_seconds)).otherwise(end)
    span = until - F.greatest(F.col("start"), F.col("bucket") * bucket_seconds)
    out = pieces.withColumn("seconds", span.cast("double")).where("seconds > 0").join(best, ["node", "bucket"], "left")
    return out.select("stay_id", "bucket", "seconds", F.coalesce("shade", F.lit(0.0)).alias("shade"))


def nearest_any(left: DataFrame, right: DataFrame, left_id: str, right_id: str, start: float = 200.0) -> DataFrame:
    """The nearest right point of every left point however far, ties to the smaller id.

    Right points lie in cubes in space, cubes in larger ones of four times the size, up to the whole earth. A left point goes down from the
    largest: of every cube one point's distance is an upper bound and the cube's own a lower one, and only cubes that may hold the
    nearest are opened. So a far cluster costs a left point a few cubes a level, not its points. Points of one place go down as one, and of
    right points of one place the smallest id stands for all. Points without coordinates are left out; without right points the result is empty.
    """
    from penumbra.operators.spatial import _on_sphere

    axes = ["x", "y", "z"]
    sizes = [start * 2]
    while sizes[-1] < geo.EARTH_RADIUS_M * 2.1:
        sizes.append(sizes[-1] * 4)

    def placed(points: DataFrame, *keep: str) -> DataFrame:
        return points.where("lon is not null and lat is not null").select(*keep, "lon", "lat", *(v.alias(a) for v, a in zip(_on_sphere(F.col("lon"), F.col("lat")), axes, strict=True)))

    def cube(size: float) -> Column:
        return F.struct(*(F.floor(F.col(a) / size).cast("long").alias(a) for a in axes))

    merged = right.groupBy("lon", "lat").agg(F.min(F.struct(right_id)).alias("_to")).select(F.col(f"_to.{right_id}").alias(right_id), "lon", "lat")
    there = cut(placed(merged, right_id).withColumn("_cube", cube(sizes[0])))
    levels = [cut(there.groupBy("_cube").agg(F.min(F.struct(*axes)).alias("_one")))]
    for _ in sizes[1:]:
        up = F.struct(*(F.floor(F.col(f"_cube.{a}") / 4).cast("long").alias(a) for a in axes))
        levels.append(cut(levels[-1].groupBy(up.alias("_cube")).agg(F.min("_one").alias("_one"))))
    here = placed(left.select("lon", "lat").distinct())
    # The largest cubes are the eight around the earth's middle.
    corners = F.array(*(F.struct(*(F.lit(c).cast("long").alias(a) for c, a in zip(cs, axes, strict=True))) for cs in product((-1, 0), repeat=3)))
    open_ = here.withColumn("_cube", F.explode(corners))
    for level in range(len(sizes) - 1, -1, -1):
        size, cubes = sizes[level], levels[level]
        far = lambda a, size=size: F.greatest(F.col(f"_cube.{a}") * size - F.col(a), F.col(a) - (F.col(f"_cube.{a}") + 1) * size, F.lit(0.0))
        length = lambda part: F.sqrt(sum((part(a) * part(a) for a in axes[1:]), part(axes[0]) * part(axes[0])))
        met = open_.join(cubes, "_cube").withColumn("_low", length(far)).withColumn("_high", length(lambda a: F.col(a) - F.col(f"_one.{a}")))
        best = F.min("_high").over(Window.partitionBy("lon", "lat"))
        kept = met.withColumn("_best", best).where(F.col("_low") <= F.col("_best") * (1 + 1e-9) + 1e-3).drop("_low", "_high", "_best", "_one")
        if level:
            below = levels[level - 1].select(F.struct(*(F.floor(F.col(f"_cube.{a}") / 4).cast("long").alias(a) for a in axes)).alias("_cube"), F.col("_cube").alias("_child"))
            kept = kept.join(below, "_cube").drop("_cube").withColumnRenamed("_child", "_cube")
        open_ = cut(kept)
    points = there.select("_cube", right_id, F.col("lon").alias("_lon"), F.col("lat").alias("_lat"))
    away = geo.haversine(F.col("lon"), F.col("lat"), F.col("_lon"), F.col("_lat"))
    best = F.min(F.struct(away.alias("metres"), right_id)).alias("b")
    near = open_.join(points, "_cube").groupBy("lon", "lat").agg(best)
    found = left.select(left_id, "lon", "lat").join(near, ["lon", "lat"]).groupBy(left_id).agg(F.min("b").alias("b"))
    return found.select(left_id, F.col(f"b.{right_id}").alias(right_id), F.col("b.metres").alias("metres"))
