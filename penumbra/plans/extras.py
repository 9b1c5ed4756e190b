"""Queries on series, lines, transfers, chains and comparisons of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penumbra.functions import lines
from penumbra.operators import clean, graph, series, transit
from penumbra.plans import networks
from penumbra.plans.geometry import _haversine, _lat, _lon, _points, lat_of, lon_of
from penumbra.plans.registry import register
from penumbra.session import table


def _minutes():
    return F.hour("ts") * 60 + F.minute("ts")


@register("""
SELECT event_type, ((hour(ts) * 60 + minute(ts)) // 60)::INTEGER AS bin, round(avg(value), 6) AS mean, count(value) AS n FROM events GROUP BY 1, 2
""")
def hourly_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value by hour of day."""
    rows = table(spark, sf_dir, "events").withColumn("minute", _minutes())
    return series.rollup(rows, ["event_type"], "minute", "value").withColumn("mean", F.round("mean", 6))


@register("""
WITH a AS (SELECT user_id, ((hour(ts) * 60 + minute(ts)) // 60)::INTEGER AS bin, avg(value) AS m FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2),
b AS (SELECT user_id, ((hour(ts) * 60 + minute(ts)) // 60)::INTEGER AS bin, avg(value) AS m FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2)
SELECT user_id, bin, round(a.m, 6) AS mean_a, round(b.m, 6) AS mean_b, a.m IS NULL OR b.m IS NULL AS partial FROM a FULL JOIN b USING (user_id, bin)
""")
def series_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even and odd events' hourly means side by side."""
    rows = table(spark, sf_dir, "events").withColumn("minute", _minutes())
    even, odd = (series.rollup(rows.where(F.col("event_id") % 2 == k), ["user_id"], "minute", "value") for k in (0, 1))
    out = series.compare(even, odd, ["user_id"])
    return out.select("user_id", "bin", F.round("mean_a", 6).alias("mean_a"), F.round("mean_b", 6).alias("mean_b"), "partial")


@register("SELECT vec_id, unnest(range(64))::INTEGER AS position, unnest(embedding) AS value, unnest(list_reverse(embedding)) AS mirrored FROM embeddings")
def zipped_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel arrays as rows."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("value"), F.reverse("embedding").alias("mirrored"))
    return series.zipped(rows, ["vec_id"], ["value", "mirrored"])


@register("""
SELECT user_id, event_id AS slot, value FROM events WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) = 1
""")
def best_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's event of least value, the first on ties."""
    rows = table(spark, sf_dir, "events").withColumn("slot", F.col("event_id"))
    return series.best_slot(rows, ["user_id"], "slot", F.col("value"))


@register("""
WITH e AS (SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS a, arg_max(o_totalprice, o_orderkey) AS b FROM orders GROUP BY 1)
SELECT o_custkey, round(b - a, 6) AS change, round((b - a) / nullif(a, 0) * 100, 6) AS percent FROM e
""")
def kpi_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of price from each customer's first order to the last."""
    out = series.first_last_change(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", "o_totalprice")
    return out.select("o_custkey", F.round("change", 6).alias("change"), F.round("percent", 6).alias("percent"))


@register(f"""
WITH p AS (SELECT 'S' || s_suppkey AS s, {_lon('s_suppkey')} AS slon, {_lat('s_suppkey')} AS slat FROM supplier),
q AS (SELECT 'C' || c_custkey AS c, {_lon('c_custkey')} AS clon, {_lat('c_custkey')} AS clat FROM customer),
m AS (SELECT s, c, round({_haversine('slon', 'slat', 'clon', 'clat')}, 4) AS metres FROM p, q WHERE {_haversine('slon', 'slat', 'clon', 'clat')} <= 1500)
SELECT s AS from_id, c AS to_id, metres FROM m UNION ALL SELECT c, s, metres FROM m
""")
def walk_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers in both directions between suppliers and customers read as stations and stops."""
    named = lambda t, k, c: _points(spark, sf_dir, t, k).withColumn("stop_id", F.concat(F.lit(c), F.col(k).cast("string")))
    return transit.walk_transfers(named("supplier", "s_suppkey", "S"), named("customer", "c_custkey", "C"), 1500.0, 4)


@register("""
WITH RECURSIVE e AS (SELECT o_orderkey AS id, o_orderkey AS a, CASE WHEN o_custkey % 8 = 0 THEN o_orderkey - o_orderkey % 50 ELSE o_orderkey + 1 END AS b FROM orders),
ends AS (SELECT id, a AS node FROM e UNION ALL SELECT id, b FROM e),
mid AS (SELECT min(id) AS x, max(id) AS y FROM ends GROUP BY node HAVING count(*) = 2 AND min(id) <> max(id)),
u AS (SELECT x, y FROM mid UNION SELECT y, x FROM mid),
r AS (SELECT id, id AS o FROM e UNION SELECT r.id, u.y FROM r JOIN u ON u.x = r.o)
SELECT id AS edge_id, min(o) AS chain FROM r GROUP BY 1
""")
def block_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of edges through nodes of exactly two edges."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    to = F.when(c % 8 == 0, o - o % 50).otherwise(o + 1)
    edges = table(spark, sf_dir, "orders").select(o.alias("edge_id"), o.alias("from_id"), to.alias("to_id"))
    return graph.chains(edges)


@register(f"""
WITH s AS (SELECT 'S' || s_suppkey AS station_id, {_lon('s_suppkey')} AS slon, {_lat('s_suppkey')} AS slat FROM supplier),
d AS (SELECT c_custkey AS door_id, {_lon('c_custkey')} AS lon, {_lat('c_custkey')} AS lat, CASE WHEN c_custkey % 3 = 0 THEN 'S' || (c_custkey % 7 + 1) || '; S' || (c_custkey % 5 + 1) END AS tag FROM customer),
t AS (SELECT door_id, min(trim(x)) AS by_tag FROM (SELECT door_id, unnest(string_split(tag, ';')) AS x FROM d) WHERE trim(x) IN (SELECT station_id FROM s) GROUP BY 1),
n AS (SELECT door_id, station_id AS by_place FROM d, s WHERE {_haversine('lon', 'lat', 'slon', 'slat')} <= 4000
  QUALIFY row_number() OVER (PARTITION BY door_id ORDER BY {_haversine('lon', 'lat', 'slon', 'slat')}, station_id) = 1)
SELECT d.door_id, coalesce(by_tag, by_place) AS station_id, CASE WHEN by_tag IS NOT NULL THEN 'tag' WHEN by_place IS NOT NULL THEN 'place' END AS how
FROM d LEFT JOIN t ON t.door_id = d.door_id LEFT JOIN n ON n.door_id = d.door_id
""")
def doors_to_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station of each door by tag, else by nearness."""
    k = F.col("c_custkey")
    tag = F.when(k % 3 == 0, F.concat(F.lit("S"), (k % 7 + 1).cast("string"), F.lit("; S"), (k % 5 + 1).cast("string")))
    doors = table(spark, sf_dir, "customer").select(k.alias("door_id"), lon_of(k).alias("lon"), lat_of(k).alias("lat"), tag.alias("tag"))
    s = F.col("s_suppkey")
    stations = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), s.cast("string")).alias("station_id"), lon_of(s).alias("lon"), lat_of(s).alias("lat"))
    return transit.tag_or_nearest(doors, stations, 4000.0)


@register("""
SELECT c_custkey, floor(((c_custkey * 7919 % 10000) / 137.0 - 30.3) * 1e5 + 0.5) / 1e5 AS lon, floor(((c_custkey * 104729 % 10000) / 139.0 - 31.7) * 1e5 + 0.5) / 1e5 AS lat FROM customer
""")
def polyline_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points encoded as polylines and read back: coordinates at five decimals."""
    k = F.col("c_custkey")
    point = F.array((k * 7919 % 10000) / F.lit(137.0) - 30.3, (k * 104729 % 10000) / F.lit(139.0) - 31.7)
    text = table(spark, sf_dir, "customer").select("c_custkey", lines.encode_polyline(F.array(F.array(F.lit(0.0), F.lit(0.0)), point)).alias("line"))
    back = F.element_at(lines.decode_polyline("line"), -1)
    return text.select("c_custkey", back[0].alias("lon"), back[1].alias("lat"))


@register("""
SELECT l_partkey, count(DISTINCT (l_returnflag, l_linestatus)) AS versions FROM lineitem GROUP BY 1 HAVING count(DISTINCT (l_returnflag, l_linestatus)) > 1
""")
def conflicting_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose lines disagree in flag or status."""
    return clean.conflicting(table(spark, sf_dir, "lineitem"), "l_partkey", ["l_returnflag", "l_linestatus"])


@register("""
SELECT *, 'found' AS side FROM (SELECT l_suppkey, l_returnflag FROM lineitem WHERE l_orderkey % 2 = 0 EXCEPT ALL SELECT l_suppkey, l_returnflag FROM lineitem WHERE l_orderkey % 2 = 1)
UNION ALL SELECT *, 'expected' FROM (SELECT l_suppkey, l_returnflag FROM lineitem WHERE l_orderkey % 2 = 1 EXCEPT ALL SELECT l_suppkey, l_returnflag FROM lineitem WHERE l_orderkey % 2 = 0)
""")
def table_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that only one of two tables has, counting repeats."""
    rows = table(spark, sf_dir, "lineitem")
    even, odd = (rows.where(F.col("l_orderkey") % 2 == k).select("l_suppkey", "l_returnflag") for k in (0, 1))
    return clean.differences(even, odd)


@register("""
WITH b AS (SELECT o_orderkey % 400 AS edge_id, (o_orderkey % 9) * 100.0 AS time_budget, (o_orderkey % 7) * 50.0 AS sun_budget, CASE WHEN o_orderkey % 3 = 0 THEN 'reachable' ELSE 'undecided' END AS status FROM orders),
p AS (SELECT DISTINCT edge_id FROM b WHERE time_budget <= 300 AND sun_budget <= 100 AND status = 'reachable')
SELECT edge_id, 'proven' AS state FROM p UNION ALL SELECT DISTINCT edge_id, 'open' FROM b WHERE status = 'undecided' AND edge_id NOT IN (SELECT edge_id FROM p)
""")
def proven_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges proven by cached results of smaller budgets, and those still open."""
    o = F.col("o_orderkey")
    results = table(spark, sf_dir, "orders").select(
        (o % 400).alias("edge_id"), ((o % 9) * 100.0).alias("time_budget"), ((o % 7) * 50.0).alias("sun_budget"), F.when(o % 3 == 0, "reachable").otherwise("undecided").alias("status")
    )
    sure, open_ = series.proven(results, 300.0, 100.0)
    return sure.withColumn("state", F.lit("proven")).union(open_.withColumn("state", F.lit("open")))


@register("""
SELECT c_mktsegment, c_custkey, c_acctbal FROM customer QUALIFY c_acctbal <= min(c_acctbal) FILTER (c_acctbal > 0) OVER (PARTITION BY c_mktsegment) * 2 + 250 AND c_acctbal > 0
""")
def detour_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes within the detour budget of the shortest one."""
    rows = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_mktsegment", "c_custkey", "c_acctbal")
    return graph.detour_gate(rows, ["c_mktsegment"], "c_acctbal").select("c_mktsegment", "c_custkey", "c_acctbal")


@register("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host and path of page addresses."""
    return table(spark, sf_dir, "pages").select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), F.coalesce(F.parse_url("url", F.lit("PATH")), F.lit("")).alias("path"))


@register()
def transit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least seconds from the starts over lines with headways, changes and walks, within 25 minutes and five boardings.

    Every customer is a stop; lines call at every fourth one, twelve lines over forty keys each; every fifth stop prices changes.
    """
    stop, nation = F.col("c_custkey"), F.col("c_nationkey")
    stops = table(spark, sf_dir, "customer").select(stop.alias("stop"), (stop % 4 + 4 * (F.floor(stop / 40) % 3)).alias("line"), nation.alias("nation"))
    there = stops.select(F.col("stop").alias("to_stop"))
    rides = stops.select("line", F.col("stop").alias("from_stop"), (F.col("stop") + 4).alias("to_stop"), (F.lit(90) + F.col("nation") % 5 * 10).alias("seconds"))
    lines = stops.select("line").distinct().where("line % 4 <> 3")
    headway = lines.select("line", F.when(F.col("line") % 4 != 2, F.lit(240) + F.col("line") * 20).alias("headway_sec"))
    walks = stops.select(F.col("stop").alias("from_stop"), (F.col("stop") + 1).alias("to_stop"), F.lit(120).alias("seconds"))
    changes = stops.select("stop", F.when(F.col("stop") % 5 == 0, 45).alias("change_sec"))
    rides, walks, starts = rides.join(there, "to_stop"), walks.join(there, "to_stop"), networks.starts(spark, sf_dir)
    # A state for every boarding is made only of stops that some start can reach.
    near = transit.within_reach(starts.select(F.col("source").alias("stop")), rides, walks, 1500.0)
    leaving = near.select(F.col("stop").alias("from_stop"))
    edges = transit.boarding_graph(rides.join(leaving, "from_stop", "left_semi"), headway, walks.join(leaving, "from_stop", "left_semi"), changes)
    begin = starts.select(F.concat(F.col("source").cast("string"), F.lit("#0")).alias("source"))
    found = graph.shortest(edges, begin, 1500.0).where(~F.col("node").contains("|"))
    number = lambda c: F.regexp_extract(c, "^[0-9]+", 0).cast("long")
    return found.groupBy(number("source").alias("source"), number("node").alias("node")).agg(F.round(F.min("seconds"), 1).alias("seconds"))
