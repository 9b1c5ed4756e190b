"""Queries on snapping to streets, way filters, permits and stays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penumbra.functions import ways
from penumbra.operators import snap
from penumbra.plans.geometry import _haversine, _lat, _lon, _points, lat_of, lon_of
from penumbra.plans.networks import _STREETS, ROW, streets
from penumbra.plans.registry import register
from penumbra.session import table


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streets between all customers, once each, two in five left out by their keys, on a grid of about 60 metres."""
    a, b = F.col("from_id"), F.col("to_id")
    one = streets(spark, sf_dir).where((a < b) & ((a * 7919 + b * 104729) % 1000 >= 400))
    lon = lambda k: F.lit(-74.0) + k % ROW * 0.0008
    lat = lambda k: F.lit(40.5) + F.floor(k / ROW) * 0.0006
    across = F.when(b == a + 1, 0).otherwise(1)
    return one.select(
        (a * 2 + across).alias("edge_id"), "from_id", "to_id", lon(a).alias("from_lon"), lat(a).alias("from_lat"), lon(b).alias("to_lon"), lat(b).alias("to_lat")
    )


def _stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as points over the streets' grid, in the rows of their customers."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    lon = F.lit(-74.0) + o * 7919 % 1000 * 0.000032
    lat = F.lit(40.5) + F.floor(c / ROW) * 0.0006 + o % 60 * 0.00001
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", lon.alias("lon"), lat.alias("lat"))


_GRID = f"""g AS (SELECT a * 2 + CASE WHEN b = a + 1 THEN 0 ELSE 1 END AS edge_id, a AS from_id, b AS to_id,
  -74.0::DOUBLE + a % {ROW} * 0.0008::DOUBLE AS ax, 40.5::DOUBLE + a // {ROW} * 0.0006::DOUBLE AS ay,
  -74.0::DOUBLE + b % {ROW} * 0.0008::DOUBLE AS bx, 40.5::DOUBLE + b // {ROW} * 0.0006::DOUBLE AS bz FROM one WHERE (a * 7919 + b * 104729) % 1000 >= 400),
p AS (SELECT o_orderkey, -74.0::DOUBLE + o_orderkey * 7919 % 1000 * 0.000032::DOUBLE AS lon,
  40.5::DOUBLE + o_custkey // {ROW} * 0.0006::DOUBLE + o_orderkey % 60 * 0.00001::DOUBLE AS lat FROM orders),
c AS (SELECT *, greatest(0.0, least(1.0, ((lon - ax) * (bx - ax) + (lat - ay) * (bz - ay)) / ((bx - ax) * (bx - ax) + (bz - ay) * (bz - ay)))) AS t
  FROM p JOIN g ON abs(p.lat - g.ay) < 0.003 AND abs(p.lon - g.ax) < 0.004),
d AS (SELECT *, {_haversine('lon', 'lat', '(ax + t * (bx - ax))', '(ay + t * (bz - ay))')} AS distance FROM c),
s AS (SELECT * FROM d WHERE distance <= 150 QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY round(distance, 6), edge_id) = 1)"""
_ONE = _STREETS[: _STREETS.index("\ne AS (") + 1]


@register(f"WITH {_ONE}{_GRID} SELECT o_orderkey, edge_id, from_id, to_id, round(t, 6) AS t, round(distance, 4) AS distance FROM s")
def snap_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The street nearest to every order within 150 metres, and the place on it."""
    found = snap.nearest_edge(_stops(spark, sf_dir), _edges(spark, sf_dir), "o_orderkey", 150.0)
    return found.select("o_orderkey", "edge_id", "from_id", "to_id", F.round("t", 6).alias("t"), F.round("distance", 4).alias("distance"))


@register(f"""
WITH {_ONE}{_GRID}, v AS (SELECT edge_id, from_id, to_id, -1 - o_orderkey AS v, t, {_haversine('ax', 'ay', 'bx', 'bz')} AS m FROM s WHERE t > 0 AND t < 1)
SELECT edge_id, v AS from_id, from_id AS to_id, round(m * t, 4) AS metres FROM v UNION ALL SELECT edge_id, v, to_id, round(m * (1 - t), 4) FROM v
UNION ALL SELECT edge_id, from_id, v, round(m * t, 4) FROM v UNION ALL SELECT edge_id, to_id, v, round(m * (1 - t), 4) FROM v
""")
def split_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streets split at the orders that snap inside them."""
    edges = _edges(spark, sf_dir)
    made = snap.split_edges(snap.nearest_edge(_stops(spark, sf_dir), edges, "o_orderkey", 150.0), edges, "o_orderkey")
    return made.select("edge_id", "from_id", "to_id", F.round("metres", 4).alias("metres"))


@register()
def snap_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stops of their customer's route, all in the largest component that one of them snaps to."""
    return snap.snap_stops(_stops(spark, sf_dir), _edges(spark, sf_dir), "o_custkey", "o_orderkey", 100.0, 150.0).withColumn("distance", F.round("distance", 4))


@register(f"""
WITH q AS (SELECT c_custkey, {_lon('c_custkey')} + (c_custkey % 5) * 3 AS lon, {_lat('c_custkey')} AS lat FROM customer),
s AS (SELECT s_suppkey, {_lon('s_suppkey')} AS slon, {_lat('s_suppkey')} AS slat FROM supplier)
SELECT c_custkey, s_suppkey, round({_haversine('lon', 'lat', 'slon', 'slat')}, 3) AS metres FROM q, s
QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY {_haversine('lon', 'lat', 'slon', 'slat')}, s_suppkey) = 1
""")
def nearest_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest supplier of every customer however far away: four of five customers lie up to twelve degrees east."""
    points = _points(spark, sf_dir, "customer", "c_custkey").withColumn("lon", F.col("lon") + F.col("c_custkey") % 5 * 3)
    found = snap.nearest_any(points, _points(spark, sf_dir, "supplier", "s_suppkey"), "c_custkey", "s_suppkey", 5000.0)
    return found.withColumn("metres", F.round("metres", 3))


def _pick(column, values: list[str | None]):
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (column % len(values) + 1).cast("int"))


_KINDS = ["steps", "cycleway", "residential", "motorway", None, "footway"]


def _case(expr: str, values: list[str | None]) -> str:
    quoted = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"([{quoted}])[({expr}) % {len(values)} + 1]"


@register(f"""
WITH e AS (SELECT p_partkey, {_case('p_partkey', _KINDS)} AS highway, {_case('p_size', ['no', None, 'yes'])} AS access, {_case('p_partkey // 6', [None, 'no', 'designated', 'dismount'])} AS bicycle,
  {_case('p_partkey // 24', ['no', 'permissive', None])} AS foot FROM part)
SELECT p_partkey, false AS walk, coalesce(bicycle = 'no', false) OR coalesce(access = 'no', false) AND coalesce(bicycle <> 'designated', true) AS bike,
  coalesce(highway = 'steps', false) OR coalesce(access = 'no', false) AND coalesce(foot <> 'permissive', true) OR coalesce(foot = 'no', false) AND coalesce(highway <> 'cycleway', true) AS scoot FROM e
""")
def edge_prohibited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts read as tagged edges: the modes that may not use them."""
    k = F.col("p_partkey")
    tags = [_pick(k, _KINDS), _pick(F.col("p_size"), ["no", None, "yes"]), _pick(F.floor(k / 6), [None, "no", "designated", "dismount"]), _pick(F.floor(k / 24), ["no", "permissive", None])]
    return table(spark, sf_dir, "part").select("p_partkey", *(ways.prohibited(m, *tags).alias(m) for m in ("walk", "bike", "scoot")))


@register(f"""
WITH w AS (SELECT o_orderkey, {_case('o_orderkey', _KINDS)} AS highway, o_custkey % 9 = 0 AS area, count(*) AS refs FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)
SELECT o_orderkey, highway, CASE WHEN o_orderkey % 4 <> 0 THEN 'asphalt' END AS surface, (1 + CASE WHEN o_orderkey % 4 <> 0 THEN 1 ELSE 0 END)::INTEGER AS tags FROM w
WHERE highway IS NOT NULL AND highway <> 'motorway' AND NOT area AND refs >= 2
""")
def kept_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read as tagged ways over their lines: the walkable ones, with the tags that are kept."""
    o = F.col("o_orderkey")
    refs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_linenumber").alias("refs"))
    surface, area = F.when(o % 4 != 0, "asphalt"), F.when(F.col("o_custkey") % 9 == 0, "yes")
    tags = F.map_from_arrays(F.array(*map(F.lit, ("highway", "surface", "area", "name"))), F.array(_pick(o, _KINDS), surface, area, F.lit("x")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", tags.alias("tags")).join(refs, "o_orderkey")
    kept = rows.where(ways.keeps_way(F.col("tags"), F.col("refs"))).select("o_orderkey", ways.kept_tags(F.col("tags")).alias("t"))
    return kept.select("o_orderkey", F.element_at("t", "highway").alias("highway"), F.element_at("t", "surface").alias("surface"), F.size("t").alias("tags"))


@register(f"""
SELECT o_custkey AS job, o_orderkey AS permit_id, o_orderdate::DATE AS expires, {_lon('o_orderkey')} AS lon, {_lat('o_orderkey')} AS lat FROM orders
WHERE o_orderpriority < '4' AND o_orderstatus = 'O' AND o_orderdate::DATE > DATE '1996-01-01' AND {_lat('o_orderkey')} BETWEEN 40.55 AND 40.8 AND {_lon('o_orderkey')} BETWEEN -74.2 AND -73.8
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE DESC, o_orderkey) = 1
""")
def active_permits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read as permits of their customer's job: the issued ones in a box that end after a day, the latest a job."""
    o = F.col("o_orderkey")
    permits = table(spark, sf_dir, "orders").select(
        o.alias("permit_id"), F.col("o_custkey").alias("job"), F.when(F.col("o_orderpriority") < "4", "Sidewalk Shed").alias("work_type"),
        F.when(F.col("o_orderstatus") == "O", "Permit Issued").alias("status"), F.to_date("o_orderdate").alias("expires"), lon_of(o).alias("lon"), lat_of(o).alias("lat"),
    )
    return ways.active_permits(permits, "1996-01-01", 40.55, -74.2, 40.8, -73.8)


@register(f"""
WITH {_STREETS}, st AS (SELECT c_custkey AS stay_id, c_custkey % 600 AS a, c_custkey % 600 + 30 + c_custkey % 200 AS z FROM customer),
pieces AS (SELECT stay_id, bucket, least(z, CASE WHEN bucket < 3 THEN (bucket + 1) * 120 ELSE z END) - greatest(a, bucket * 120) AS seconds FROM st, range(4) t(bucket)),
best AS (SELECT a AS node, bucket, max(((k + bucket * 29) % 11) / 10.0::DOUBLE) AS shade FROM e, range(4) t(bucket) GROUP BY 1, 2)
SELECT stay_id, bucket::INTEGER AS bucket, seconds::DOUBLE AS seconds, coalesce(shade, 0.0) AS shade FROM pieces LEFT JOIN (SELECT node, bucket AS b, shade FROM best) ON node = stay_id AND b = bucket WHERE seconds > 0
""")
def stay_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stay at every customer's crossing, cut into two-minute buckets on the shadiest street."""
    c = F.col("c_custkey")
    stays = table(spark, sf_dir, "customer").select(c.alias("stay_id"), c.alias("node"), (c % 600).alias("start"), (c % 200 + 30).alias("seconds"))
    return snap.stay_exposure(stays, streets(spark, sf_dir), 120.0, 4)
