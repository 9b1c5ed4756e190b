"""Places along lines: distances of points along a shape, the part of it between two stops, and the point at a distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penumbra.functions import geo


def with_distances(points: Column) -> Column:
    """The points (lon, lat) of a line as ``lon, lat, at``: metres from its start along it."""
    metres = lambda p, q: geo.haversine(p["lon"], p["lat"], q["lon"], q["lat"])
    steps = lambda r: F.zip_with(F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r) - 1), metres)
    sums = lambda r: F.aggregate(
        steps(r), F.array(F.lit(0.0)), lambda done, step: F.concat(done, F.array(F.element_at(done, -1) + step))
    )
    return F.when(F.size(points) > 0, F.zip_with(points, sums(points), lambda p, at: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"), at.alias("at")))).otherwise(
        F.array().cast("array<struct<lon:double,lat:double,at:double>>")
    )


def segments(shapes: DataFrame) -> DataFrame:
    """``shape_id, place, ax, ay, bx, by, start, length`` of every segment of ``shapes(shape_id, line)``, whose line ``with_distances`` made."""
    pairs = F.zip_with(F.slice("line", 1, F.size("line") - 1), F.slice("line", 2, F.size("line") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    spread = shapes.where("size(line) >= 2").select("shape_id", F.posexplode(pairs).alias("place", "s"))
    return spread.select(
        "shape_id", "place", F.col("s.a.lon").alias("ax"), F.col("s.a.lat").alias("ay"), F.col("s.b.lon").alias("bx"), F.col("s.b.lat").alias("by"), F.col("s.a.at").alias("start"), (F.col("s.b.at") - F.col("s.a.at")).alias("length")
    )


def along(stops: DataFrame, parts: DataFrame, stop_id: str) -> DataFrame:
    """``(stop_id), place, at, distance``: the point of its shape nearest to every stop ``shape_id, lon, lat``; the first one where the shape
    comes by twice. Distances are on the plane at the stop; equal to a micrometre they tie to the lower place."""
    k = F.cos(F.radians("lat"))
    flat = lambda x, y: ((F.col(x) - F.col("lon")) * k * geo.METRES_PER_DEGREE, (F.col(y) - F.col("lat")) * geo.METRES_PER_DEGREE)
    t, away = geo.project_on_segment(F.lit(0.0), F.lit(0.0), *flat("ax", "ay"), *flat("bx", "by"))
    met = stops.where("lon is not null and lat is not null").join(parts, "shape_id").select(stop_id, "place", "start", "length", F.inline(F.array(F.struct(t.alias("t"), away.alias("distance")))))
    best = met.groupBy(stop_id).agg(F.min(F.struct(F.round("distance", 6).alias("near"), "place", (F.col("start") + F.col("t") * F.col("length")).alias("at"), "distance")).alias("b"))
    return best.select(stop_id, "b.place", "b.at", "b.distance")


def slices(rides: DataFrame, shapes: DataFrame) -> DataFrame:
    """The part of its shape that every ride ``edge_id, shape_id, from_lon, from_lat, to_lon, to_lat`` takes: ``edge_id, interior, metres, snap``.

    ``interior`` holds the shape's points strictly between the stops, ``snap`` is the farther stop's distance from the shape. Where the second
    stop doesn't lie after the first, as where a shape doubles back, and without a shape, all are null: what lies between isn't told.
    """
    lines = shapes.select("shape_id", with_distances(F.col("points")).alias("line"))
    ends = F.array(*(F.struct(F.lit(i).alias("end"), F.col(f"{n}_lon").alias("lon"), F.col(f"{n}_lat").alias("lat")) for i, n in enumerate(("from", "to"))))
    stops = rides.select("edge_id", "shape_id", F.inline(ends)).withColumn("stop", F.struct("edge_id", "end"))
    found = along(stops, segments(lines), "stop")
    pick = lambda i, c: F.max(F.when(F.col("stop.end") == i, F.col(c)))
    both = found.groupBy(F.col("stop.edge_id").alias("edge_id")).agg(
        pick(0, "place").alias("i"), pick(1, "place").alias("j"), pick(0, "at").alias("a"), pick(1, "at").alias("b"), F.max("distance").alias("snap")
    )
    onward = (F.col("j") >= F.col("i")) & (F.col("b") > F.col("a"))
    told = rides.select("edge_id", "shape_id").join(both.where(onward), "edge_id", "left").join(lines, "shape_id", "left")
    inner = F.transform(F.slice("line", F.col("i") + 2, F.col("j") - F.col("i")), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    return told.select("edge_id", F.when(F.col("i").isNotNull(), inner).alias("interior"), (F.col("b") - F.col("a")).alias("metres"), F.when(F.col("i").isNotNull(), F.col("snap")).alias("snap"))


def point_at(line: Column, metres: Column) -> Column:
    """The point (lon, lat) at a distance along a line that ``with_distances`` made, its ends beyond them; null for an empty line."""
    after = F.filter(line, lambda p: p["at"] >= metres)
    before = F.filter(line, lambda p: p["at"] < metres)
    a, b = F.element_at(before, -1), F.get(after, F.lit(0))
    share = (metres - a["at"]) / F.nullif(b["at"] - a["at"], F.lit(0.0))
    mid = lambda c: a[c] + (b[c] - a[c]) * share
    plain = lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))
    return (
        F.when(F.size(line) == 0, None)
        .when(F.size(before) == 0, plain(b))
        .when(F.size(after) == 0, plain(F.try_element_at(before, F.lit(-1))))
        .otherwise(F.struct(mid("lon").alias("lon"), mid("lat").alias("lat")))
    )
