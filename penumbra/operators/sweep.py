"""Shade and shelter of many instants at once: one set of candidates serves all directions.

Points go to tiles of the plane with all walls in reach of them, where each ray is held against the walls from near to far until the densest is in its
way or it has passed above the tallest (``lee``, numpy in tasks by tile). So pairs of points and walls are neither written nor shuffled: an edge
travels once with all its samples, and comes back with an array of values, one a slot. Edges and points of one place are one, and prisms of one outline and opacity
the tallest of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penumbra.functions import clock, exposure, geo
from penumbra.operators import lee
from penumbra.operators.shade import sample_count, sample_point
from penumbra.operators.spatial import _packed, spread
from penumbra.session import cut

#: Farthest wall that counts, in metres; months, quarter hours of a day from 05:00, and the day and year that stand for a month; fixed values.
PAD_M, MONTHS, DAY_SLOTS, DAY, YEAR = 400.0, 12, 64, 15, 2026
#: Width of the tiles that points are dealt to, in metres; samples of an edge and points of a task that travel together. Samples up to ``EDGE_SPACING``
#: metres apart lie up to ``PART_M`` from the middle one of their part.
TILE_M, PART, TASK_POINTS, EDGE_SPACING, EDGE_OFFSET = 256.0, 16, 2048, 25.0, 4.0
PART_M = PART / 2 * EDGE_SPACING + 2 * EDGE_OFFSET + 1
#: Offsets of a point's probes in metres; fixed values.
PROBES = [(0.0, 0.0), (-4.0, 0.0), (4.0, 0.0), (0.0, -4.0), (0.0, 4.0)]
#: Rain lower than this angle docks the confidence of walls by the factor; fixed values.
LOW_RAIN, LOW_RAIN_FACTOR = 70.0, 0.85


def slot_directions(cells: DataFrame, zone: str, year: int = YEAR) -> DataFrame:
    """``cell, slot, azimuth, altitude`` of the sun for every ``cell, lon, lat`` at the 768 slots: quarter hours from 05:00 by the zone's clock
    on the fifteenth of each month."""
    slots = cells.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(MONTHS * DAY_SLOTS - 1))))
    minutes = F.col("slot") % DAY_SLOTS * 15 + 300
    month = F.floor(F.col("slot") / DAY_SLOTS).cast("int") + 1
    instant = F.make_timestamp(F.lit(year), month, F.lit(DAY), F.floor(minutes / 60).cast("int"), minutes % 60, F.lit(0), F.lit(zone))
    azimuth, altitude = exposure.sun_position(instant, F.col("lon"), F.col("lat"))
    # An array of one element, unrolled, keeps the long formulas from being put wherever their values are used.
    return slots.select("cell", "slot", F.inline(F.array(F.struct(azimuth.alias("azimuth"), altitude.alias("altitude")))))


def rain_directions(weather: DataFrame) -> DataFrame:
    """``cell, slot, azimuth, altitude`` of the way that rain comes from, for ``cell, slot, from_deg, wind`` (m/s; unknown is calm)."""
    return weather.select("cell", "slot", F.coalesce(F.pmod("from_deg", F.lit(360.0)), F.lit(0.0)).alias("azimuth"), exposure.rain_angle(F.col("wind")).alias("altitude"))


def rain_prisms(prisms: DataFrame) -> DataFrame:
    """Prisms as rain meets them: walls and sheds (no opacity) keep it off, crowns (with the opacity to light) in part."""
    return prisms.withColumn("opacity", exposure.rain_opacity(F.col("opacity")))


def _summed(halves: int, pad: float, schema: T.StructType):
    """For the units of a task, its prisms and directions: the sums of each unit's points in every direction, null where it isn't lit."""

    def run(units: pa.Table, rest: pa.Table) -> pa.Table:
        out = {n: units.column(n) for n in schema.names if n not in ("slots", "sums")}
        suns = rest.filter(rest.column("up").is_valid())
        if not units.num_rows or not suns.num_rows:
            return pa.table({n: c.slice(0, 0) for n, c in out.items()} | {"slots": rest.column("slots").slice(0, 0), "sums": pa.array([], pa.list_(pa.float64()))})
        flat = lambda column, kind: np.asarray(column.combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=kind)
        up = flat(suns.column("up").slice(0, 1), bool)
        ux, uy, slope = (flat(suns.column(c).slice(0, 1), float)[up] for c in ("ux", "uy", "slope"))
        rings = rest.column("walls").combine_chunks().flatten()
        sizes = rings.field("xs").value_lengths().to_numpy()
        corners = [np.asarray(rings.field(c).flatten().to_numpy(zero_copy_only=False), dtype=float) for c in ("xs", "ys")]
        walls = lee.Walls(*corners, sizes, rings.field("height").to_numpy(zero_copy_only=False), rings.field("opacity").to_numpy(zero_copy_only=False))
        best = lee.densest(flat(units.column("xs"), float), flat(units.column("ys"), float), walls, ux, uy, slope, pad)
        lengths = np.repeat(units.column("xs").combine_chunks().value_lengths().to_numpy() // halves, halves)
        sums = np.full((len(lengths), len(up)), np.nan)
        sums[:, up] = np.add.reduceat(best, np.cumsum(lengths) - lengths, axis=0)
        lists = lambda values, width: pa.ListArray.from_arrays(pa.array(np.arange(units.num_rows + 1, dtype=np.int32) * width), values)
        slots = suns.column("slots").slice(0, 1).combine_chunks().flatten()
        again = slots.take(pa.array(np.tile(np.arange(len(up)), units.num_rows)))
        return pa.table(out | {"slots": lists(again, len(up)), "sums": lists(pa.array(sums.reshape(-1), from_pandas=True), len(up) * halves)})

    return run


def _swept(units: DataFrame, prisms: DataFrame, directions: DataFrame, halves: int, a_task: int, margin: float, pad: float) -> DataFrame:
    """``units`` with ``slots``, those of their cell in order, and ``sums``: of their points' densest prisms in the way, for every slot, null where the altitude is
    0 or less, one half of the points after the other. Units of cells without directions have no row.

    ``units`` has ``cell`` and the points' ``xs`` and ``ys``, which lie within ``margin`` metres of the middle one. A task takes ``a_task`` units of a tile
    that lie beside each other, and gets the prisms in reach of the tile.
    """
    slot = F.struct(
        "slot", F.sin(F.radians("azimuth")).alias("ux"), F.cos(F.radians("azimuth")).alias("uy"), F.tan(F.radians("altitude")).alias("slope"), (F.coalesce("altitude", F.lit(0.0)) > 0).alias("up")
    )
    rows = directions.groupBy("cell").agg(F.sort_array(F.collect_list(slot)).alias("d"))
    suns = rows.select("cell", *(F.col(f"d.{c}").alias(n) for c, n in (("slot", "slots"), ("ux", "ux"), ("uy", "uy"), ("slope", "slope"), ("up", "up"))))
    # Of one outline and opacity the tallest prism is in the way wherever another is.
    merged = prisms.where((F.col("height") > 0) & (F.size("ring") > 0)).groupBy("ring", F.coalesce("opacity", F.lit(1.0)).cast("double").alias("opacity")).agg(F.max("height").cast("double").alias("height"))
    tile = lambda v: geo.grid_cell(v, TILE_M)
    middle = lambda c: F.element_at(c, (F.floor(F.size(c) / (2 * halves)) + 1).cast("int"))
    dealt = units.withColumn("_tx", tile(middle("xs"))).withColumn("_ty", tile(middle("ys")))
    beside = Window.partitionBy("cell", "_tx", "_ty").orderBy(F.floor(middle("ys") / lee.STRIP), middle("xs"))
    dealt = cut(dealt.withColumn("_pack", F.floor((F.row_number().over(beside) - 1) / a_task).cast("int")))
    key = ["cell", "_tx", "_ty", "_pack"]
    packs = cut(dealt.select(*key).distinct())
    xs, ys = F.col("ring.x"), F.col("ring.y")
    laid = merged.select(xs.alias("xs"), ys.alias("ys"), "height", "opacity")
    for n, c in (("_tx", "xs"), ("_ty", "ys")):
        laid = laid.withColumn(n, F.explode(F.sequence(tile(F.array_min(c) - pad - margin), tile(F.array_max(c) + pad + margin))))
    # Few rows with long arrays: what a row costs on its way to Python grows with the rows before it.
    near = _packed(laid.join(packs.select("_tx", "_ty").distinct(), ["_tx", "_ty"], "left_semi"), ["_tx", "_ty"], "walls")
    names = {f.name: f.dataType for f in [near.schema["walls"], *suns.schema.fields] if f.name != "cell"}
    filled = lambda df: df.select(*key, *(F.col(n) if n in df.columns else F.lit(None).cast(t).alias(n) for n, t in names.items()))
    rest = filled(packs.join(near, ["_tx", "_ty"])).union(filled(packs.join(suns, "cell")))
    slots = T.ArrayType(suns.schema["slots"].dataType.elementType)
    schema = T.StructType([*dealt.drop(*key[1:]).schema.fields, T.StructField("slots", slots), T.StructField("sums", T.ArrayType(T.DoubleType()))])
    return spread(dealt, key).groupBy(*key).cogroup(spread(rest, key).groupBy(*key)).applyInArrow(_summed(halves, pad, schema), schema)


def sweep(points: DataFrame, prisms: DataFrame, directions: DataFrame, keys: list[str], pad: float = PAD_M) -> DataFrame:
    """Where a point lies in the lee: ``keys, slot, opacity``, a row a point and slot with any, the densest prism in the way.

    ``points`` has ``keys, cell, x, y`` in metres; ``prisms`` has ``prism_id, ring, height, opacity`` (null: opaque); ``directions`` has ``cell, slot,
    azimuth, altitude`` in degrees. A prism is in the way if the ray towards the azimuth crosses its outline within ``pad`` metres
    where the prism is higher than the ray. A prism that the point lies in doesn't count, nor one of no opacity. Slots with an altitude of 0 or less have no
    rows.
    """
    place = ["cell", "x", "y"]
    places = points.select(*place).distinct().where("x is not null and y is not null").select(*place, F.array(F.col("x").cast("double")).alias("xs"), F.array(F.col("y").cast("double")).alias("ys"))
    found = _swept(places, prisms, directions, 1, TASK_POINTS, 0.0, pad)
    hit = F.filter(F.arrays_zip("slots", "sums"), lambda v: v["sums"] > 0)
    rows = cut(found.select(*place, hit.alias("_hit")))
    return points.select(*keys, *place).join(rows, place).select(*keys, F.inline("_hit").alias("slot", "opacity"))


def _sides(edges: DataFrame, prisms: DataFrame, directions: DataFrame, pad: float) -> DataFrame:
    """``cell, ids, samples, slots, sums``: of all edges of one place (``ids`` holds up to 4,096 structs of their other columns) the sums of ``_swept`` on the left, then on the right,
    over ``samples`` a side. Edges of no length have none.

    Samples lie as in ``edge_samples``. A long edge is dealt out in parts of 16 samples, whose sums are put together again.
    """
    place = ["cell", "ax", "ay", "bx", "by"]
    one = _packed(edges.where(sample_count(EDGE_SPACING)[0] > 0), place, "ids").withColumn("_n", sample_count(EDGE_SPACING)[1])
    parts = one.withColumn("_part", F.explode(F.sequence(F.lit(0), F.floor(F.col("_n") / PART).cast("int"))))
    steps = F.sequence(F.col("_part") * PART, F.least("_n", F.col("_part") * PART + PART - 1))
    line = lambda axis, offset: F.transform(steps, lambda i: sample_point(i, F.col("_n"), F.lit(offset))[axis].cast("double"))
    both = lambda axis: F.concat(line(axis, EDGE_OFFSET), line(axis, -EDGE_OFFSET))
    units = parts.select("cell", *place[1:], "ids", "_n", "_part", both(0).alias("xs"), both(1).alias("ys"))
    found = cut(_swept(units, prisms, directions, 2, max(1, TASK_POINTS // 8), PART_M, pad).drop("xs", "ys"))
    samples = (F.col("_n") + 1).alias("samples")
    whole = found.where(F.col("_n") < PART).select("cell", "ids", samples, "slots", "sums")
    added = F.aggregate(F.slice("_p", 2, F.size("_p")), F.element_at("_p", 1)["sums"], lambda a, p: F.zip_with(a, p["sums"], lambda v, w: v + w))
    long = found.where(F.col("_n") >= PART).groupBy(*place, "ids", "_n", "slots").agg(F.sort_array(F.collect_list(F.struct("_part", "sums"))).alias("_p"))
    return whole.union(long.select("cell", "ids", samples, "slots", added.alias("sums")))


def _half(left: bool) -> Column:
    slots = F.size("slots")
    return F.slice("sums", 1, slots) if left else F.slice("sums", slots + 1, slots)


def edge_sweep(edges: DataFrame, prisms: DataFrame, directions: DataFrame, night: float = 1.0, pad: float = PAD_M) -> DataFrame:
    """Mean shade (or shelter) of both sides of every edge in every slot of its cell: ``cell, edge_id, side, slot, shade``.

    ``edges`` has ``edge_id, cell, ax, ay, bx, by`` (other columns are handed on); samples lie as in ``edge_samples``. Where the altitude is 0 or less the value is ``night``. Edges of
    no length have no samples and no rows.
    """
    found = _sides(edges, prisms, directions, pad)
    every = found.select("cell", "samples", "slots", "sums", F.explode("ids").alias("_id")).select("cell", "samples", "slots", "_id.*", F.posexplode("sums").alias("_place", "sum"))
    side, slot = F.when(F.col("_place") < F.size("slots"), "left").otherwise("right"), F.get("slots", F.col("_place") % F.size("slots"))
    rest = [c for c in edges.columns if c not in ("edge_id", "cell", "ax", "ay", "bx", "by")]
    return every.select("cell", "edge_id", side.alias("side"), slot.alias("slot"), F.coalesce(F.col("sum") / F.col("samples"), F.lit(night)).alias("shade"), *rest)


def _resolved(edges: DataFrame, resolved: DataFrame | None) -> DataFrame:
    """``edges`` with ``_known``, whether ``resolved(cell)`` names their cell."""
    if resolved is None:
        return edges.withColumn("_known", F.lit(True))
    return edges.join(resolved.select("cell").distinct().withColumn("_known", F.lit(True)), "cell", "left")


def _unresolved(slot: Column) -> Column:
    why = F.concat(F.lit("unresolved: cell "), F.col("cell").cast("string"), F.lit(", segment "), F.col("edge_id").cast("string"), F.lit(", slot "), slot.cast("string"))
    return F.raise_error(why)


def shade_cells(edges: DataFrame, prisms: DataFrame, directions: DataFrame, resolved: DataFrame | None = None, pad: float = PAD_M) -> DataFrame:
    """The shade table of cells: ``cell, edge_id, side, slot, shade_byte``, 255 for full shade and night.

    A cell that ``resolved(cell)`` doesn't name has no geometry to measure with; an edge in it ends the job with an error, as a 0 there would
    be a sunny street that nothing measured.
    """
    swept = edge_sweep(_resolved(edges, resolved), prisms, directions, 1.0, pad)
    byte = F.when(F.col("_known"), clock.fraction_byte(F.col("shade"))).otherwise(_unresolved(F.col("slot")).cast("int"))
    return swept.select("cell", "edge_id", "side", "slot", byte.alias("shade_byte"))


def shade_payloads(edges: DataFrame, prisms: DataFrame, directions: DataFrame, resolved: DataFrame | None = None, pad: float = PAD_M) -> DataFrame:
    """``packed(shade_cells(...))`` without the rows in between: ``cell, edge_id, slots, payload``."""
    found = _sides(_resolved(edges, resolved), prisms, directions, pad)
    byte = lambda v: clock.fraction_byte(F.coalesce(v / F.col("samples"), F.lit(1.0)))
    pairs = F.zip_with(_half(True), _half(False), lambda a, b: F.lpad(F.hex(byte(a) * 256 + byte(b)), 4, "0"))
    # An array of one element, unrolled, is packed once for all edges of a place.
    rows = found.select("cell", "ids", "slots", F.explode(F.array(F.unhex(F.array_join(pairs, "")))).alias("payload")).select("cell", "slots", "payload", F.inline("ids"))
    payload = F.when(F.col("_known"), F.col("payload")).otherwise(_unresolved(F.element_at("slots", 1)).cast("binary"))
    return rows.select("cell", "edge_id", F.size("slots").alias("slots"), payload.alias("payload"))


def packed(table: DataFrame) -> DataFrame:
    """``cell, edge_id, slots, payload``: two bytes a slot in order, left and right, of every edge of the shade table; at most 1,536."""
    row = F.sort_array(F.collect_list(F.struct("slot", "side", "shade_byte")))
    text = F.array_join(F.transform("row", lambda r: F.lpad(F.hex(r["shade_byte"]), 2, "0")), "")
    rows = table.groupBy("cell", "edge_id").agg(row.alias("row"))
    return rows.select("cell", "edge_id", (F.size("row") / 2).cast("int").alias("slots"), F.unhex(text).alias("payload"))


def unpacked(profiles: DataFrame) -> DataFrame:
    """The long form of ``packed`` rows again."""
    places = F.posexplode(F.transform(F.sequence(F.lit(1), F.octet_length("payload")), lambda i: F.conv(F.hex(F.substring("payload", i, F.lit(1))), 16, 10).cast("int"))).alias("place", "shade_byte")
    rows = profiles.where(F.octet_length("payload") > 0).select("cell", "edge_id", places)
    return rows.select("cell", "edge_id", F.when(F.col("place") % 2 == 0, "left").otherwise("right").alias("side"), F.floor(F.col("place") / 2).cast("int").alias("slot"), "shade_byte")


def point_shade(points: DataFrame, prisms: DataFrame, directions: DataFrame, keys: list[str], pad: float = PAD_M) -> DataFrame:
    """``keys, slot, shade``: the mean of five probes, at the point and four metres to each side; 1 where the altitude is 0 or less."""
    offsets = F.array(*(F.struct(F.lit(i).alias("probe"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for i, (dx, dy) in enumerate(PROBES)))
    spread = points.withColumn("_o", F.explode(offsets))
    probes = spread.select(*keys, "cell", F.col("_o.probe").alias("probe"), (F.col("x") + F.col("_o.dx")).alias("x"), (F.col("y") + F.col("_o.dy")).alias("y"))
    lee = sweep(probes, prisms, directions, [*keys, "probe"], pad).groupBy(*keys, "slot").agg(F.sum("opacity").alias("sum"))
    every = points.select(*keys, "cell").join(directions.select("cell", "slot", (F.col("altitude") > 0).alias("up")), "cell").join(lee, [*keys, "slot"], "left")
    return every.select(*keys, "slot", F.when(F.col("up"), F.coalesce("sum", F.lit(0.0)) / len(PROBES)).otherwise(1.0).alias("shade"))


def rain_edges(edges: DataFrame, prisms: DataFrame, weather: DataFrame, pad: float = PAD_M) -> DataFrame:
    """Shelter of both sides of every edge from the rain of every ``weather(cell, slot, from_deg, wind)``: ``cell, edge_id, side, slot, shelter,
    factor``. ``factor`` docks the confidence where the rain is low, as walls then shelter by a wind that they bend."""
    ways = rain_directions(weather)
    swept = edge_sweep(edges, rain_prisms(prisms), ways, 0.0, pad)
    factor = ways.select("cell", "slot", F.when(F.col("altitude") < LOW_RAIN, F.lit(LOW_RAIN_FACTOR)).otherwise(1.0).alias("factor"))
    return swept.join(factor, ["cell", "slot"]).select("cell", "edge_id", "side", "slot", F.col("shade").alias("shelter"), "factor")


def grid_points(boxes: DataFrame, columns: int, rows: int) -> DataFrame:
    """The middles of a grid over every ``cell, west, south, east, north``: ``cell, column, row, x, y``, rows from the north."""
    spread = boxes.withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    x = F.col("west") + (F.col("column") + 0.5) / columns * (F.col("east") - F.col("west"))
    y = F.col("north") - (F.col("row") + 0.5) / rows * (F.col("north") - F.col("south"))
    return spread.select("cell", "column", "row", x.alias("x"), y.alias("y"))


def rain_grid(boxes: DataFrame, columns: int, rows: int, prisms: DataFrame, weather: DataFrame, pad: float = PAD_M) -> DataFrame:
    """Shelter of the middles of a grid: ``cell, column, row, slot, shelter``."""
    points, ways = grid_points(boxes, columns, rows), rain_directions(weather)
    lee = sweep(points, rain_prisms(prisms), ways, ["cell", "column", "row"], pad)
    every = points.select("cell", "column", "row").join(ways.select("cell", "slot"), "cell").join(lee, ["cell", "column", "row", "slot"], "left")
    return every.select("cell", "column", "row", "slot", F.coalesce("opacity", F.lit(0.0)).alias("shelter"))


def rain_exposure(legs: DataFrame, keys: list[str], walk_speed: float = 1.4) -> DataFrame:
    """Seconds in the rain of trips: ``outdoor, sheltered_outdoor, unknown_outdoor, sheltered_ride, unknown_ride, total, whole_known``.

    ``legs`` has ``kind`` (walk or ride), ``metres, shelter`` of walks, and of rides ``travel_seconds, wait_seconds, vehicle_sheltered, wait_shelter,
    wait_coverage``. A vehicle counts as shelter only where it is said to be; a wait only where at least 0.6 of its surroundings are known.
    """
    least = lambda c: F.greatest(F.lit(0.0), F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    part = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c)))
    walk = F.col("kind") == "walk"
    on_foot = F.when(walk, least("metres") / walk_speed).otherwise(0.0)
    wait = F.when(walk, 0.0).otherwise(least("wait_seconds"))
    ride = F.when(walk, 0.0).otherwise(F.greatest(F.lit(0.0), F.coalesce(F.col("travel_seconds").cast("double"), F.lit(0.0)) - F.coalesce(F.col("wait_seconds").cast("double"), F.lit(0.0))))
    known_wait = F.col("wait_shelter").isNotNull() & (F.coalesce("wait_coverage", F.lit(0.0)) >= 0.6)
    inside = F.coalesce("vehicle_sheltered", F.lit(False))
    outdoor, total = on_foot + wait, on_foot + wait + ride
    sheltered = F.when(walk & F.col("shelter").isNotNull(), on_foot * part("shelter")).when(~walk & known_wait, wait * part("wait_shelter")).otherwise(0.0)
    unknown = F.when(walk, F.when(F.col("shelter").isNull(), on_foot).otherwise(0.0)).otherwise(F.when(known_wait, 0.0).otherwise(wait))
    sums = legs.groupBy(*keys).agg(
        F.sum(outdoor).alias("outdoor"), F.sum(sheltered).alias("sheltered_outdoor"), F.sum(unknown).alias("unknown_outdoor"),
        F.sum(F.when(inside, ride).otherwise(0.0)).alias("sheltered_ride"), F.sum(F.when(inside, 0.0).otherwise(ride)).alias("unknown_ride"), F.sum(total).alias("total"),
    )
    return sums.withColumn("whole_known", (F.col("unknown_outdoor") <= 0) & (F.col("unknown_ride") <= 0))
