"""How much of a ride runs in tunnels, on bridges and so on: samples along the ride against the ways of its own service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penumbra.functions import geo
from penumbra.operators.snap import nearest_edge

#: Metres between samples, the fewest and most samples of a ride, the farthest way that counts, and the least share of samples
#: with one for a finding at all; fixed values.
SPACING_M, FEWEST, MOST, MATCH_M, COVERAGE = 50.0, 8, 60, 120.0, 0.5


def structure_of(tags: Column) -> Column:
    """The structure that a way's tags tell: a tag counts unless it is ``no``; tunnel before bridge before cutting before embankment."""
    has = lambda tag: F.coalesce((tags[tag] != "no") & (tags[tag] != ""), F.lit(False))
    return F.when(has("tunnel"), "underground").when(has("bridge"), "elevated").when(has("cutting"), "open_cut").when(has("embankment"), "embankment")


def service_ways(relations: DataFrame, ways: DataFrame, excluded_operator: str | None = None) -> DataFrame:
    """The segments of every way that carries a service: ``ref, way_id, structure, segment_id``, its ends' coordinates.

    ``relations`` has ``tags`` and ``members`` (type, ref); ``ways`` has ``way_id, tags, points`` (lon, lat). A way takes the refs of the relations that
    it is a member of, which leaves out sidings; relations of an operator that matches ``excluded_operator`` (any case), platforms and ways
    of fewer than two points don't count. A way without a structure tag is ``at_grade``.
    """
    kept = relations.where(F.coalesce(F.col("tags")["ref"], F.lit("")) != "")
    if excluded_operator:
        kept = kept.where(~F.coalesce(F.col("tags")["operator"], F.lit("")).rlike(f"(?i){excluded_operator}"))
    members = kept.select(F.col("tags")["ref"].alias("ref"), F.explode("members").alias("m")).where("m.type = 'way'").select("ref", F.col("m.ref").alias("way_id")).distinct()
    platform = (F.col("tags")["railway"] == "platform") | (F.col("tags")["public_transport"] == "platform")
    track = ways.where(~F.coalesce(platform, F.lit(False))).where("size(points) >= 2")
    pairs = F.zip_with(F.slice("points", 1, F.size("points") - 1), F.slice("points", 2, F.size("points") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    laid = track.select("way_id", F.coalesce(structure_of(F.col("tags")), F.lit("at_grade")).alias("structure"), F.posexplode(pairs).alias("place", "s"))
    return laid.join(members, "way_id").select(
        "ref", "way_id", "structure", F.struct("way_id", "place").alias("segment_id"), F.col("s.a.lon").alias("from_lon"), F.col("s.a.lat").alias("from_lat"), F.col("s.b.lon").alias("to_lon"), F.col("s.b.lat").alias("to_lat")
    )


def shares(rides: DataFrame, ways: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """``edge_id, structure, share, determined``: the share of each structure along every ride; what no way is near of is ``unknown``.

    ``rides`` has ``edge_id, ref`` and its ends' coordinates; ``ways`` as ``service_ways`` gives. Samples lie on the straight line between the ends, both
    included; each takes the nearest way of the ride's own ref (``aliases`` renames refs) closer than the cap, ties to the smaller way.
    Shares add up to 1. A ride is ``determined`` where at least half its samples found a way.
    """
    ref = F.col("ref")
    if aliases:
        ref = F.coalesce(F.create_map(*(F.lit(x) for pair in sorted(aliases.items()) for x in pair))[ref], ref)
    ends = ["from_lon", "from_lat", "to_lon", "to_lat"]
    count = F.greatest(F.lit(FEWEST), F.least(F.lit(MOST), F.floor(geo.haversine(*map(F.col, ends)) / SPACING_M + 0.5))).cast("int")
    spread = rides.select("edge_id", ref.alias("ref"), *ends, count.alias("n")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n"))))
    f = F.col("i") / F.col("n")
    points = spread.select(
        F.struct("edge_id", "i").alias("point"), "ref", (F.col("from_lon") + (F.col("to_lon") - F.col("from_lon")) * f).alias("lon"), (F.col("from_lat") + (F.col("to_lat") - F.col("from_lat")) * f).alias("lat")
    )
    laid = ways.select(F.col("segment_id").alias("edge_id"), F.col("structure").alias("from_id"), F.lit(None).cast("string").alias("to_id"), "ref", *ends)
    met = nearest_edge(points, laid, "point", MATCH_M, ["ref"]).where(F.col("distance") < MATCH_M)
    found = met.groupBy(F.col("point.edge_id").alias("edge_id"), F.col("from_id").alias("structure")).agg(F.count("*").alias("k"))
    total = rides.select("edge_id", (count + 1).alias("total"))
    some = found.join(total, "edge_id").select("edge_id", "structure", (F.col("k") / F.col("total")).alias("share"))
    known = total.join(found.groupBy("edge_id").agg(F.sum("k").alias("k")), "edge_id", "left").select("edge_id", (F.coalesce("k", F.lit(0)) / F.col("total")).alias("known"))
    none = known.where("known < 1").select("edge_id", F.lit("unknown").alias("structure"), (1 - F.col("known")).alias("share"))
    return some.union(none).join(known, "edge_id").select("edge_id", "structure", "share", (F.col("known") >= COVERAGE).alias("determined"))
