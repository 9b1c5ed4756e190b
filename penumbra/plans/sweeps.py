"""Queries on shade and rain of many instants, over edges at the suppliers and prisms of the suppliers on a plane."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penumbra.operators import sweep
from penumbra.plans.geometry import _plane
from penumbra.plans.registry import register
from penumbra.session import table

_CELL = "(floor({x} / 500) * 2 + floor({y} / 500))::BIGINT"
_PLANE = "(({k} * 7919 % 10000) / 10.0::DOUBLE)", "(({k} * 104729 % 10000) / 10.0::DOUBLE)"
_X, _Y = (p.format(k="s_suppkey") for p in _PLANE)
#: Square prisms as walls; every fifth is a crown.
_WALLS = f"""sq AS (SELECT s_suppkey AS pid, {_X} AS cx, {_Y} AS cy, 5.0::DOUBLE + s_suppkey % 20 AS r, 10.0::DOUBLE + s_suppkey % 30 AS h, CASE WHEN s_suppkey % 5 = 0 THEN 0.6::DOUBLE END AS op FROM supplier),
wall AS (SELECT pid, cx, cy, r, h, op, unnest([cx - r, cx + r, cx + r, cx - r]) AS wx, unnest([cy - r, cy - r, cy + r, cy + r]) AS wy,
  unnest([2 * r, 0, -2 * r, 0]) AS ex, unnest([0, 2 * r, 0, -2 * r]) AS ey FROM sq)"""
#: The sun over four cells at the 768 slots; the clock is four hours behind from March to October, else five.
_SUNS = f"""cell AS (SELECT DISTINCT {_CELL.format(x=_X, y=_Y)} AS cell FROM supplier),
inst AS (SELECT cell, slot, -74.0::DOUBLE + cell * 0.01::DOUBLE AS lon, 40.5::DOUBLE + cell * 0.02::DOUBLE AS lat,
  epoch_us(make_timestamp(2026, slot // 64 + 1, 15, (300 + slot % 64 * 15) // 60, slot % 64 * 15 % 60, 0.0)) / 1e6 + CASE WHEN slot // 64 BETWEEN 2 AND 9 THEN 4 ELSE 5 END * 3600 AS t
  FROM cell, (SELECT unnest(range(768)) AS slot)),
d1 AS (SELECT *, t / 86400 - 10957.5 AS d FROM inst),
d2 AS (SELECT *, radians(((d * 0.98560028 + 357.528) % 360 + 360) % 360) AS g, radians(23.439 - d * 4e-7) AS tilt FROM d1),
d3 AS (SELECT *, radians(((d * 0.9856474 + 280.460) % 360 + 360) % 360 + sin(g) * 1.915 + sin(g * 2) * 0.020) AS e, radians(((d * 360.98564736629 + 280.46061837 + lon) % 360 + 360) % 360) AS sid, radians(lat) AS phi FROM d2),
d4 AS (SELECT *, asin(sin(tilt) * sin(e)) AS dec, sid - atan2(cos(tilt) * sin(e), cos(e)) AS hour FROM d3),
dir AS (SELECT cell, slot, degrees(atan2(-sin(hour), tan(dec) * cos(phi) - sin(phi) * cos(hour))) AS azimuth, degrees(asin(sin(phi) * sin(dec) + cos(phi) * cos(dec) * cos(hour))) AS altitude FROM d4)"""
_RAIN = f"""cell AS (SELECT DISTINCT {_CELL.format(x=_X, y=_Y)} AS cell FROM supplier),
dir AS (SELECT cell, n_nationkey AS slot, (n_nationkey * 37 % 360)::DOUBLE AS azimuth, greatest(10.0, least(89.5, 90 - degrees(atan((n_nationkey % 12) / 9.0::DOUBLE)))) AS altitude FROM cell, nation)"""


def _hits(points: str, keys: str, opacity: str) -> str:
    """The densest prism in the way of points ``px, py, cell`` in every direction of their cell."""
    return f"""ray AS (SELECT cell, slot, sin(radians(azimuth)) AS ux, cos(radians(azimuth)) AS uy, tan(radians(altitude)) AS slope FROM dir WHERE altitude > 0),
seen AS (SELECT {keys}, cell, wx - px AS qx, wy - py AS qy, ex, ey, h, {opacity} AS op FROM {points} JOIN wall ON abs(px - cx) < 450 AND abs(py - cy) < 450
  WHERE NOT (px >= cx - r AND px < cx + r AND py >= cy - r AND py < cy + r)),
met AS (SELECT *, ux * ey - uy * ex AS c FROM seen JOIN ray USING (cell)),
hit AS (SELECT {keys}, slot, max(op) AS op FROM (SELECT *, (qx * ey - qy * ex) / c AS d, (qx * uy - qy * ux) / c AS s FROM met WHERE c <> 0)
  WHERE s >= 0 AND s < 1 AND d > 0 AND d <= 400 AND h > d * slope GROUP BY ALL)"""


_EDGES = f"""ed AS (SELECT s_suppkey AS edge_id, {_CELL.format(x=_X, y=_Y)} AS cell, {_X} AS ax, {_Y} AS ay, s_suppkey % 90 - 45 AS dx, 30.0::DOUBLE AS dy FROM supplier),
el AS (SELECT *, sqrt(dx * dx + dy * dy) AS len, greatest(3, ceil(sqrt(dx * dx + dy * dy) / 25))::INTEGER AS n FROM ed),
sm AS (SELECT edge_id, cell, side, n, i, ax + dx * i / n::DOUBLE - dy / len * o AS px, ay + dy * i / n::DOUBLE + dx / len * o AS py
  FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM el), (VALUES ('left', 4.0::DOUBLE), ('right', -4.0::DOUBLE)) v(side, o))"""


def _cell(x, y):
    return (F.floor(x / 500) * 2 + F.floor(y / 500)).cast("long")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _plane(spark, sf_dir, "supplier", "s_suppkey"), F.col("s_suppkey") % 90
    return a.select(
        F.col("s_suppkey").alias("edge_id"), _cell(F.col("x"), F.col("y")).alias("cell"), F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("x") + (b - 45)).alias("bx"), (F.col("y") + 30).alias("by")
    )


def _prisms(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.lit(5.0) + F.col("s_suppkey") % 20
    corner = lambda a, b: F.struct((F.col("x") + r * a).alias("x"), (F.col("y") + r * b).alias("y"))
    ring = F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))
    opacity = F.when(F.col("s_suppkey") % 5 == 0, 0.6)
    return _plane(spark, sf_dir, "supplier", "s_suppkey").select(F.col("s_suppkey").alias("prism_id"), ring.alias("ring"), (F.lit(10.0) + F.col("s_suppkey") % 30).alias("height"), opacity.alias("opacity"))


def _suns(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _edges(spark, sf_dir).select("cell").distinct()
    return sweep.slot_directions(cells.select("cell", (F.lit(-74.0) + F.col("cell") * 0.01).alias("lon"), (F.lit(40.5) + F.col("cell") * 0.02).alias("lat")), "America/New_York")


def _weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as weather records of each of the four cells."""
    key = F.col("n_nationkey")
    spread = table(spark, sf_dir, "nation").select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("cell"))
    return spread.select("cell", key.alias("slot"), (key * 37 % 360).cast("double").alias("from_deg"), (key % 12).cast("double").alias("wind"))


_BYTES = f"""WITH {_WALLS}, {_SUNS}, {_EDGES}, {_hits("sm", "edge_id, side, i", "coalesce(op, 1.0)")},
sums AS (SELECT edge_id, side, slot, sum(op) AS s FROM hit GROUP BY 1, 2, 3),
bytes AS (SELECT cell, edge_id, side, slot, CASE WHEN altitude <= 0 THEN 255 ELSE floor(coalesce(s, 0) / (n + 1) * 255.0 + 0.5)::INTEGER END AS shade_byte
  FROM (SELECT DISTINCT cell, edge_id, side, n FROM sm) JOIN dir USING (cell) LEFT JOIN sums USING (edge_id, side, slot))"""


@register(f"{_BYTES} SELECT cell, edge_id, side, slot::INTEGER AS slot, shade_byte FROM bytes")
def shade_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shade bytes of both sides of every edge at the 768 slots, in four cells."""
    edges = _edges(spark, sf_dir)
    return sweep.shade_cells(edges, _prisms(spark, sf_dir), _suns(spark, sf_dir), edges.select("cell"))


@register(f"""{_BYTES} SELECT cell, edge_id, 768::INTEGER AS slots, sha256(unhex(string_agg(lpad(to_hex(shade_byte), 2, '0'), '' ORDER BY slot, side))) AS sha256
FROM bytes GROUP BY 1, 2""")
def shade_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table packed, two bytes a slot, and the digest of every edge's payload."""
    edges = _edges(spark, sf_dir)
    rows = sweep.shade_payloads(edges, _prisms(spark, sf_dir), _suns(spark, sf_dir), edges.select("cell"))
    return rows.select("cell", "edge_id", "slots", F.sha2("payload", 256).alias("sha256"))


_CX, _CY = (p.format(k="c_custkey") for p in _PLANE)


@register(f"""
WITH {_WALLS}, one AS (SELECT c_custkey, 0 AS cell, {_CX} AS x, {_CY} AS y FROM customer),
dir AS (SELECT 0 AS cell, n_regionkey AS slot, 225.0 - n_regionkey * 40 AS azimuth, n_regionkey * 12.0 AS altitude FROM (SELECT r_regionkey AS n_regionkey FROM region)),
pr AS (SELECT c_custkey, cell, p, x + CASE p WHEN 1 THEN -4 WHEN 2 THEN 4 ELSE 0 END AS px, y + CASE p WHEN 3 THEN -4 WHEN 4 THEN 4 ELSE 0 END AS py FROM one, (SELECT unnest(range(5)) AS p)),
{_hits("pr", "c_custkey, p", "coalesce(op, 1.0)")},
sums AS (SELECT c_custkey, slot, sum(op) AS s FROM hit GROUP BY 1, 2)
SELECT c_custkey, slot, round(CASE WHEN altitude <= 0 THEN 1.0 ELSE coalesce(s, 0) / 5 END, 6) AS shade FROM one JOIN dir USING (cell) LEFT JOIN sums USING (c_custkey, slot)
""")
def point_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shade of every customer's place by five probes, the regions being five instants, the first at night."""
    points = _plane(spark, sf_dir, "customer", "c_custkey").select("c_custkey", _cell(F.col("x"), F.col("y")).alias("cell"), "x", "y")
    key = F.col("r_regionkey")
    cells = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("cell")
    times = table(spark, sf_dir, "region").select(cells, key.alias("slot"), (F.lit(225.0) - key * 40).alias("azimuth"), (key * 12.0).alias("altitude"))
    return sweep.point_shade(points, _prisms(spark, sf_dir), times, ["c_custkey"]).withColumn("shade", F.round("shade", 6))


_RAIN_OP = "CASE WHEN op IS NULL THEN 1.0 ELSE 0.1 + greatest(0.0, least(1.0, (op - 0.3) / 0.6)) * 0.3 END"


@register(f"""
WITH {_WALLS}, {_RAIN}, {_EDGES}, {_hits("sm", "edge_id, side, i", _RAIN_OP)},
sums AS (SELECT edge_id, side, slot, sum(op) AS s FROM hit GROUP BY 1, 2, 3)
SELECT cell, edge_id, side, slot, round(coalesce(s, 0) / (n + 1), 6) AS shelter, CASE WHEN altitude < 70 THEN 0.85 ELSE 1.0 END::DOUBLE AS factor
FROM (SELECT DISTINCT cell, edge_id, side, n FROM sm) JOIN dir USING (cell) LEFT JOIN sums USING (edge_id, side, slot)
""")
def rain_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shelter of both sides of every edge from slanted rain, the nations being weather records."""
    return sweep.rain_edges(_edges(spark, sf_dir), _prisms(spark, sf_dir), _weather(spark, sf_dir)).withColumn("shelter", F.round("shelter", 6))


@register(f"""
WITH {_WALLS}, {_RAIN},
box AS (SELECT {_CELL.format(x=_X, y=_Y)} AS cell, min({_X}) AS w, max({_X}) AS e, min({_Y}) AS s0, max({_Y}) AS n0 FROM supplier GROUP BY 1),
gp AS (SELECT cell, c, r_, w + (c + 0.5) / 24 * (e - w) AS px, n0 - (r_ + 0.5) / 16 * (n0 - s0) AS py FROM box, (SELECT unnest(range(24)) AS c), (SELECT unnest(range(16)) AS r_)),
{_hits("gp", "cell, c, r_", _RAIN_OP).replace("SELECT cell, c, r_, cell, wx", "SELECT cell, c, r_, wx").replace("SELECT *, ux * ey - uy * ex AS c FROM", "SELECT *, ux * ey - uy * ex AS k FROM").replace("/ c AS d", "/ k AS d").replace("/ c AS s FROM met WHERE c <> 0", "/ k AS s FROM met WHERE k <> 0")}
SELECT cell, c::INTEGER AS column, r_::INTEGER AS row, slot, round(coalesce(op, 0), 6) AS shelter FROM gp JOIN dir USING (cell) LEFT JOIN hit USING (cell, c, r_, slot)
""")
def rain_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shelter on a grid of 24 by 16 over the suppliers of each cell in every weather record."""
    edges = _edges(spark, sf_dir)
    boxes = edges.groupBy("cell").agg(F.min("ax").alias("west"), F.max("ax").alias("east"), F.min("ay").alias("south"), F.max("ay").alias("north"))
    return sweep.rain_grid(boxes, 24, 16, _prisms(spark, sf_dir), _weather(spark, sf_dir)).withColumn("shelter", F.round("shelter", 6))


@register("""
WITH l AS (SELECT l_orderkey, l_linenumber % 2 = 1 AS walk, l_quantity * 20 AS m, CASE WHEN l_partkey % 5 <> 0 THEN l_discount * 12 - 0.1 END AS sh, (l_extendedprice / 100)::DOUBLE AS tr,
  (l_suppkey % 9 * 60)::DOUBLE AS wt, CASE l_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS vs, CASE WHEN l_partkey % 4 <> 0 THEN l_tax * 10 END AS ws, (l_suppkey % 10) / 10.0::DOUBLE AS wc FROM lineitem),
p AS (SELECT *, CASE WHEN walk THEN m / 1.4 ELSE 0 END AS foot, CASE WHEN walk THEN 0 ELSE wt END AS wait, CASE WHEN walk THEN 0 ELSE greatest(0, tr - wt) END AS ride, ws IS NOT NULL AND wc >= 0.6 AS kw FROM l)
SELECT l_orderkey, round(sum(foot + wait), 4) AS outdoor,
  round(sum(CASE WHEN walk AND sh IS NOT NULL THEN foot * greatest(0, least(1, sh)) WHEN NOT walk AND kw THEN wait * greatest(0, least(1, ws)) ELSE 0 END), 4) AS sheltered_outdoor,
  round(sum(CASE WHEN walk THEN CASE WHEN sh IS NULL THEN foot ELSE 0 END WHEN kw THEN 0 ELSE wait END), 4) AS unknown_outdoor,
  round(sum(CASE WHEN coalesce(vs, false) THEN ride ELSE 0 END), 4) AS sheltered_ride, round(sum(CASE WHEN coalesce(vs, false) THEN 0 ELSE ride END), 4) AS unknown_ride,
  round(sum(foot + wait + ride), 4) AS total,
  sum(CASE WHEN walk THEN CASE WHEN sh IS NULL THEN foot ELSE 0 END WHEN kw THEN 0 ELSE wait END) <= 0 AND sum(CASE WHEN coalesce(vs, false) THEN 0 ELSE ride END) <= 0 AS whole_known
FROM p GROUP BY 1
""")
def rain_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as trips whose lines are walks and rides in turn: seconds in the rain, sheltered and unknown."""
    k, s = F.col("l_partkey"), F.col("l_suppkey")
    legs = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.when(F.col("l_linenumber") % 2 == 1, "walk").otherwise("ride").alias("kind"), (F.col("l_quantity") * 20).alias("metres"), F.when(k % 5 != 0, F.col("l_discount") * 12 - 0.1).alias("shelter"),
        (F.col("l_extendedprice") / 100).cast("double").alias("travel_seconds"), (s % 9 * 60).alias("wait_seconds"), F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("vehicle_sheltered"),
        F.when(k % 4 != 0, F.col("l_tax") * 10).alias("wait_shelter"), (s % 10 / 10.0).alias("wait_coverage"),
    )
    sums = sweep.rain_exposure(legs, ["l_orderkey"])
    names = ["outdoor", "sheltered_outdoor", "unknown_outdoor", "sheltered_ride", "unknown_ride", "total"]
    return sums.select("l_orderkey", *(F.round(c, 4).alias(c) for c in names), "whole_known")
