"""Rules on tagged ways and permits as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of way on which one can walk, tags that are kept, and access values that lift a general ban.
WALKABLE = [
    "footway", "path", "pedestrian", "living_street", "residential", "unclassified", "tertiary", "secondary", "service", "cycleway",
    "steps", "track", "bridleway",
]
KEPT_TAGS = ["highway", "surface", "smoothness", "cycleway", "bicycle", "foot", "access"]
LIFTS_BAN = ["yes", "designated", "permissive"]


def keeps_way(tags: Column, refs: Column) -> Column:
    """Walkable ways of at least two nodes that aren't areas; a way without tags or nodes is none."""
    area = F.coalesce(F.element_at(tags, "area") == "yes", F.lit(False))
    return F.coalesce(F.element_at(tags, "highway").isin(WALKABLE) & ~area & (F.size(refs) >= 2), F.lit(False))


def kept_tags(tags: Column) -> Column:
    """The map with the kept tags that are present."""
    return F.map_filter(tags, lambda k, v: k.isin(KEPT_TAGS) & v.isNotNull())


def prohibited(mode: str, highway: Column, access: Column, bicycle: Column, foot: Column) -> Column:
    """Whether a mode may not use an edge; a missing tag bans nothing."""
    def banned(own: Column) -> Column:
        return F.coalesce(access == "no", F.lit(False)) & ~F.coalesce(own.isin(LIFTS_BAN), F.lit(False))

    if mode == "bike":
        return F.coalesce(bicycle == "no", F.lit(False)) | banned(bicycle)
    if mode == "scoot":
        off_foot = F.coalesce(foot == "no", F.lit(False)) & ~F.coalesce(highway == "cycleway", F.lit(False))
        return F.coalesce(highway == "steps", F.lit(False)) | banned(foot) | off_foot
    return F.lit(False)


def active_permits(permits: DataFrame, today: str, south: float, west: float, north: float, east: float) -> DataFrame:
    """Issued sidewalk-shed permits inside a box that end after ``today``, one a job: the latest end, then the smallest id.

    ``permits`` has ``permit_id, job, work_type, status, expires`` (date), ``lon`` and ``lat``; rows without a job, an end or a finite
    place other than zero are left out.
    """
    inside = F.col("lat").between(south, north) & F.col("lon").between(west, east) & (F.col("lat") != 0) & (F.col("lon") != 0)
    live = permits.where((F.col("work_type") == "Sidewalk Shed") & (F.col("status") == "Permit Issued") & (F.col("expires") > F.to_date(F.lit(today))))
    named = live.where(inside & F.col("job").isNotNull() & (F.col("job").cast("string") != ""))
    best = F.max_by(F.struct("permit_id", "lon", "lat", "expires"), F.struct("expires", -F.col("permit_id")))
    return named.groupBy("job").agg(best.alias("b")).select("job", "b.permit_id", "b.lon", "b.lat", "b.expires")
