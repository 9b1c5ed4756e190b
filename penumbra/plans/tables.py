"""Queries on aggregation, order, cleaning, selection and time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penumbra.operators import clean, exposure, sequences, stats, temporal, topk, transit
from penumbra.plans.registry import register
from penumbra.session import table
from penumbra.streaming import stateful


def _seconds(name: str = "ts"):
    return F.unix_micros(F.col(name).cast("timestamp")) / 1e6


@register("""
WITH first AS (SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY 1, 2, date_trunc('day', ts)),
hourly AS (SELECT event_type, user_id % 5 AS service, (epoch_us(ts) // 1000000) % 86400 AS sec, ((epoch_us(ts) // 1000000) % 86400) // 3600 AS hour FROM first),
seen AS (SELECT DISTINCT event_type, hour, sec FROM hourly),
gaps AS (SELECT event_type, hour, sec - lag(sec) OVER (PARTITION BY event_type, hour ORDER BY sec) AS gap FROM seen),
heads AS (SELECT event_type, hour, median(gap) AS headway_sec, count(*) AS departures FROM gaps GROUP BY 1, 2 HAVING count(*) >= 4)
SELECT event_type, hour::INTEGER AS hour, headway_sec, departures, services
FROM heads JOIN (SELECT event_type, hour, count(DISTINCT service) AS services FROM hourly GROUP BY 1, 2) USING (event_type, hour)
""")
def headway_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median gap of each type's distinct first departures a day and user, by hour."""
    events = table(spark, sf_dir, "events")
    trips = events.groupBy("user_id", "event_type", F.date_trunc("day", "ts").alias("day")).agg(F.min("ts").alias("ts"))
    rows = trips.select("event_type", (F.col("user_id") % 5).alias("service"), (F.floor(_seconds()) % 86400).alias("sec"))
    return transit.headways(rows, ["event_type"], "sec", "service").select("event_type", "hour", "headway_sec", "departures", "services")


@register("""
WITH steps AS (
  SELECT lag(event_type) OVER w AS from_stop, event_type AS to_stop, epoch_us(ts) // 1000000 - lag(epoch_us(ts) // 1000000) OVER w AS seconds
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT from_stop, to_stop, floor(median(seconds) + 0.5)::BIGINT AS median_sec, count(*) AS samples
FROM steps WHERE from_stop <> to_stop AND seconds > 0 GROUP BY 1, 2 HAVING count(*) >= 3
""")
def edge_median_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median seconds between consecutive events of a user, by pair of types."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.floor(_seconds()).alias("sec"), F.struct("ts", "event_id").alias("place"))
    return transit.edge_medians(rows, "user_id", "place", "event_type", "sec", [])


@register("""
WITH cal AS (SELECT c_custkey % 20 AS service_id, min(c_custkey % 7) AS off, DATE '1996-01-01' AS s FROM customer GROUP BY 1),
days AS (SELECT service_id, unnest(generate_series(s, s + INTERVAL 59 DAY, INTERVAL 1 DAY))::DATE AS day, off FROM cal),
weekly AS (SELECT service_id, day FROM days WHERE isodow(day) - 1 <> off),
exc AS (SELECT DISTINCT o_custkey % 20 AS service_id, o_orderdate::DATE AS day, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS kind
        FROM orders WHERE o_orderdate >= '1996-01-01' AND o_orderdate < '1996-03-01'),
act AS (SELECT * FROM weekly UNION SELECT service_id, day FROM exc WHERE kind = 1)
SELECT service_id, day FROM act a WHERE NOT EXISTS (SELECT 1 FROM exc e WHERE e.kind = 2 AND e.service_id = a.service_id AND e.day = a.day)
""")
def service_calendar_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly patterns of twenty services with added and removed dates."""
    services = table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 20).alias("service_id")).agg(F.min(F.col("c_custkey") % 7).alias("off"))
    days = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda d: d != F.col("off"))
    start = F.to_date(F.lit("1996-01-01"))
    calendar = services.select("service_id", days.alias("days"), start.alias("start"), F.date_add(start, 59).alias("end"))
    orders = table(spark, sf_dir, "orders").where((F.col("o_orderdate") >= "1996-01-01") & (F.col("o_orderdate") < "1996-03-01"))
    kind = F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(2)
    exceptions = orders.select((F.col("o_custkey") % 20).alias("service_id"), F.to_date("o_orderdate").alias("day"), kind.alias("kind")).distinct()
    return transit.active_dates(calendar, exceptions)


@register("""
WITH act AS (SELECT DISTINCT o_orderdate::DATE AS day, o_custkey % 4 AS service_id FROM orders),
prints AS (SELECT day, string_agg(service_id::VARCHAR, '|' ORDER BY service_id::VARCHAR) AS services FROM act GROUP BY day),
groups AS (SELECT CASE WHEN isodow(day) < 6 THEN 'weekday' WHEN isodow(day) = 6 THEN 'saturday' ELSE 'sunday' END AS kind, services, count(*) AS dates, min(day) AS day FROM prints GROUP BY 1, 2)
SELECT kind, day, dates, services FROM groups QUALIFY row_number() OVER (PARTITION BY kind ORDER BY dates DESC, day) = 1
""")
def representative_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date that stands for each day type: the largest group of dates with the same services."""
    from penumbra.functions.clock import day_type

    orders = table(spark, sf_dir, "orders")
    active = orders.select(F.to_date("o_orderdate").alias("day"), (F.col("o_custkey") % 4).cast("string").alias("service_id")).distinct()
    return transit.representative_dates(active, day_type(F.col("day")))


@register("""
WITH base AS (
  SELECT user_id, ts, event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value > 50 END AS state, round(value, 2) AS len FROM events),
m AS (SELECT *, lag(state) OVER w AS before, row_number() OVER w AS rn FROM base WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(CASE WHEN rn > 1 AND state IS NOT DISTINCT FROM before THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM m),
runs AS (SELECT user_id, run, any_value(state) AS state, sum(len) AS len FROM r WHERE state IS NOT NULL GROUP BY 1, 2),
longest AS (SELECT user_id, max(len) FILTER (state) AS lp, max(len) FILTER (NOT state) AS le FROM runs GROUP BY 1),
totals AS (SELECT user_id, sum(CASE WHEN state THEN len ELSE 0 END) AS protected, sum(CASE WHEN NOT state THEN len ELSE 0 END) AS exposed,
  sum(CASE WHEN state IS NULL THEN len ELSE 0 END) AS unknown, count(CASE WHEN state <> before THEN 1 END) AS transitions FROM m GROUP BY 1)
SELECT user_id, round(protected, 4) AS protected, round(exposed, 4) AS exposed, round(unknown, 4) AS unknown, transitions,
  round(coalesce(lp, 0), 4) AS longest_protected, round(coalesce(le, 0), 4) AS longest_exposed
FROM totals LEFT JOIN longest USING (user_id)
""")
def continuity_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest protected and exposed runs of each user; every eleventh event is unknown."""
    events = table(spark, sf_dir, "events")
    state = F.when(F.col("event_id") % 11 != 0, F.col("value") > 50)
    out = sequences.continuity(events, ["user_id"], ["ts", "event_id"], state, F.round("value", 2))
    return out.select("user_id", "transitions", *[F.round(c, 4).alias(c) for c in ("protected", "exposed", "unknown", "longest_protected", "longest_exposed")])


@register("""
WITH x AS (SELECT DISTINCT l_suppkey, l_orderkey AS x FROM lineitem),
g AS (SELECT *, x - row_number() OVER (PARTITION BY l_suppkey ORDER BY x) AS island FROM x)
SELECT l_suppkey, min(x) AS x0, max(x) AS x1 FROM g GROUP BY l_suppkey, island
""")
def rle_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive orders by supplier."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_orderkey").alias("x"))
    return sequences.encode_islands(rows, ["l_suppkey"], "x")


@register("SELECT DISTINCT l_suppkey, l_orderkey AS x FROM lineitem")
def rle_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same runs, expanded again."""
    return sequences.decode_islands(rle_islands(spark, sf_dir), ["l_suppkey"], "x")


@register("""
WITH t AS (SELECT user_id, epoch_us(ts) / 1e6 AS t FROM events),
n AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= 86400 THEN 0 ELSE 1 END AS new FROM t),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t RANGE UNBOUNDED PRECEDING) AS session FROM n)
SELECT user_id, session::BIGINT AS session, min(t) AS first, max(t) AS last, count(*) AS rows FROM s GROUP BY 1, 2
""")
def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user's events with gaps of a day at most."""
    return sequences.gap_sessions(table(spark, sf_dir, "events"), ["user_id"], _seconds(), 86400)


_POINTS = {"p50": 50, "p75": 75, "p90": 90, "p95": 95, "p99": 99, "most": 100}


@register("""
WITH s AS (SELECT l_returnflag, list_sort(list(l_extendedprice)) AS v FROM lineitem GROUP BY 1)
SELECT l_returnflag, """ + ", ".join(f"v[floor({p} / 100.0 * (len(v) - 1) + 0.5)::BIGINT + 1] AS {n}" for n, p in _POINTS.items()) + " FROM s")
def percentile_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles of prices."""
    return stats.percentile_nearest_rank(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"], _POINTS)


@register("SELECT l_returnflag, " + ", ".join(f"quantile_cont(l_extendedprice, {p / 100.0}) AS {n}" for n, p in _POINTS.items()) + " FROM lineitem GROUP BY 1")
def percentile_r7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated percentiles of prices."""
    return stats.percentile_linear(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"], _POINTS)


@register("""
WITH s AS (SELECT list_sort(list(l_quantity)) AS v FROM lineitem)
SELECT v[least(len(v) - 1, floor(0.5 * len(v))::BIGINT) + 1] AS half, v[least(len(v) - 1, floor(0.9 * len(v))::BIGINT) + 1] AS ninety, v[len(v)] AS all_of_it FROM s
""")
def percentile_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floor-index percentiles of quantities over the whole table."""
    return stats.percentile_floor(table(spark, sf_dir, "lineitem"), "l_quantity", [], {"half": 0.5, "ninety": 0.9, "all_of_it": 1.0})


@register("SELECT p_size AS size, count(*) AS n FROM part GROUP BY 1")
def histogram_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(table(spark, sf_dir, "part"), F.col("p_size"), "size")


@register("""
SELECT CASE WHEN l_quantity < 5 THEN 0 WHEN l_quantity < 10 THEN 1 WHEN l_quantity < 25 THEN 2 WHEN l_quantity < 40 THEN 3 ELSE 4 END AS bin,
  count(*) AS n, round(avg(CASE WHEN l_discount >= 0.05 THEN 1.0 ELSE 0.0 END), 9) AS share FROM lineitem WHERE l_quantity >= 0 GROUP BY 1
""")
def height_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed bins with the share of each over a threshold."""
    bins = stats.fixed_bins(F.col("l_quantity"), [0, 5, 10, 25, 40]).alias("bin")
    over = F.when(F.col("l_discount") >= 0.05, 1.0).otherwise(0.0)
    return table(spark, sf_dir, "lineitem").groupBy(bins).agg(F.count("*").alias("n"), F.round(F.avg(over), 9).alias("share"))


@register("""
SELECT l_shipmode, round(min(v), 6) AS least, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95, round(max(v), 6) AS most,
  round((quantile_cont(v, 0.95) - quantile_cont(v, 0.05)) / 2 / quantile_cont(v, 0.5) * 100, 6) AS spread_pct
FROM (SELECT l_linenumber AS l_shipmode, l_extendedprice AS v FROM lineitem) GROUP BY 1
""")
def bench_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of prices by line number."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("l_shipmode"), F.col("l_extendedprice").alias("v"))
    out = stats.spread_percent(rows, "v", ["l_shipmode"])
    return out.select("l_shipmode", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@register("""
WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END AS v FROM part),
g AS (SELECT p_brand, median(v) AS m FROM p GROUP BY 1)
SELECT p_partkey, coalesce(v, m, (SELECT median(v) FROM p), 10.0) AS v,
  CASE WHEN v IS NOT NULL THEN 'measured' WHEN m IS NOT NULL THEN 'group_median' ELSE 'overall_median' END AS v_source
FROM p LEFT JOIN g USING (p_brand)
""")
def impute_group_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh price is missing and comes from its brand's median."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice")).alias("v"))
    return clean.impute_median(rows, "v", "p_brand", 10.0).select("p_partkey", "v", "v_source")


@register("""
SELECT CASE WHEN o_totalprice < 1000 THEN 'small' WHEN o_orderstatus = 'F' THEN 'status' WHEN o_orderdate < '1993-01-01' THEN 'old' END AS reason, count(*) AS n
FROM orders GROUP BY 1 HAVING reason IS NOT NULL
""")
def reject_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by the first rule that they break."""
    rules = [("small", F.col("o_totalprice") < 1000), ("status", F.col("o_orderstatus") == "F"), ("old", F.col("o_orderdate") < "1993-01-01")]
    return clean.reject(table(spark, sf_dir, "orders"), rules)[1]


@register("""
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) = 1
""")
def dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First line of each order."""
    return clean.keep_first(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"]).select(
        "l_orderkey", "l_linenumber", "l_partkey"
    )


@register("""
SELECT 'order' AS kind, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0)
UNION ALL SELECT 'part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'supplier', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)
""")
def dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose order (a fifth are taken out), part or supplier is missing."""
    lines = table(spark, sf_dir, "lineitem")
    parents = [
        ("order", "l_orderkey", table(spark, sf_dir, "orders").where("o_orderkey % 5 <> 0"), "o_orderkey"),
        ("part", "l_partkey", table(spark, sf_dir, "part"), "p_partkey"),
        ("supplier", "l_suppkey", table(spark, sf_dir, "supplier"), "s_suppkey"),
    ]
    out = None
    for kind, key, parent, parent_key in parents:
        n = transit.dangling(lines, parent, key, parent_key).agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
        out = n if out is None else out.union(n)
    return out


@register("""
SELECT l_orderkey, count(*) FILTER (l_linenumber = po) AS repeated, count(*) FILTER (l_shipdate < pv) AS backwards FROM (
  SELECT l_orderkey, l_linenumber, l_shipdate, lag(l_linenumber) OVER w AS po, lag(l_shipdate) OVER w AS pv FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate)) GROUP BY 1
""")
def order_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated line numbers and ship dates that run backwards."""
    return sequences.order_violations(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", "l_shipdate")


@register("""
WITH e AS (SELECT event_id, epoch_us(ts) / 1e6 AS t, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v FROM events),
q AS (SELECT * FROM e WHERE event_id % 20 = 0), r AS (SELECT t AS rt, v FROM e WHERE event_id % 20 <> 0 AND v IS NOT NULL),
m AS (SELECT event_id, rt, abs(t - rt) AS away, r.v, row_number() OVER (PARTITION BY event_id ORDER BY abs(t - rt), rt, r.v) AS n FROM q JOIN r ON abs(t - rt) <= 5400)
SELECT q.event_id, m.rt AS right_time, m.away, m.v AS value FROM q LEFT JOIN m ON m.event_id = q.event_id AND n = 1
""")
def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every twentieth event the nearest other one with a value, within 90 minutes."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"))
    left, right = e.where("event_id % 20 = 0"), e.where("event_id % 20 <> 0")
    return temporal.nearest_in_time(left, right, "event_id", _seconds(), _seconds(), ["value"], 5400, required="value")


@register("""
WITH v AS (SELECT o_custkey, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_until, o_orderkey, o_totalprice FROM orders)
SELECT o_custkey, valid_from, o_totalprice FROM v WHERE valid_from <= '1996-06-01' AND (valid_until IS NULL OR valid_until >= '1996-06-01')
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY valid_from DESC, o_orderkey DESC, o_totalprice DESC) = 1
""")
def bitemporal_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's order as a version, resolved at one instant."""
    from pyspark.sql import Window

    orders = table(spark, sf_dir, "orders")
    until = F.lead("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    versions = orders.select("o_custkey", F.col("o_orderdate").alias("valid_from"), until.alias("valid_until"), "o_orderkey", "o_totalprice")
    at = F.lit("1996-06-01").cast("timestamp_ntz")
    return temporal.valid_version(versions, "o_custkey", "valid_from", "valid_until", "o_orderkey", at, "o_totalprice")


@register("""
WITH f AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) = 1)
SELECT * FROM f ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 4
""")
def topk_per_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four dearest lines, one a supplier."""
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    return topk.best_per_group(table(spark, sf_dir, "lineitem"), "l_suppkey", order, 4).select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")


_FRONT = """
SELECT p_partkey, p_retailprice, p_size FROM part a WHERE NOT EXISTS (
  SELECT 1 FROM part b WHERE b.p_retailprice <= a.p_retailprice AND b.p_size >= a.p_size AND (b.p_retailprice < a.p_retailprice OR b.p_size > a.p_size))
"""


@register(_FRONT)
def skyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that no other part beats in price and size."""
    return topk.skyline(table(spark, sf_dir, "part"), "p_partkey", "p_retailprice", "p_size").select("p_partkey", "p_retailprice", "p_size")


@register(f"""
WITH f AS ({_FRONT}), r AS (SELECT min(p_retailprice) AS a, max(p_retailprice) AS b, min(p_size) AS c, max(p_size) AS d FROM f)
SELECT p_partkey, p_retailprice, p_size, round(sqrt(pow((p_retailprice - a) / CASE WHEN a = b THEN 1 ELSE b - a END, 2) + pow((d - p_size) / CASE WHEN c = d THEN 1.0 ELSE d - c END, 2)), 9) AS ideal_distance
FROM f, r ORDER BY ideal_distance, p_partkey LIMIT 1
""")
def knee_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The front's part nearest to the ideal corner."""
    return topk.knee(skyline(spark, sf_dir), "p_partkey", "p_retailprice", "p_size").withColumn("ideal_distance", F.round("ideal_distance", 9))


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return v.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q")), v


@register("""
WITH p AS (SELECT q.vec_id AS query_id, c.vec_id AS id, list_sum(list_transform(list_zip(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
  FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY d, id)::INTEGER AS rank, id, round(d, 6) AS distance FROM p
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, id) <= 5
""")
def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest vectors of every twentieth one."""
    return topk.nearest_vectors(*_vectors(spark, sf_dir), 5).withColumn("distance", F.round("distance", 6))


@register()
def knn_two_stage_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of a quantised shortlist of 100 against the exact ten."""
    queries, vectors = _vectors(spark, sf_dir)
    return topk.recall(topk.two_stage(queries, vectors, 0.01, 100, 10), topk.nearest_vectors(queries, vectors, 10))


_CENTRES = [[((i * 31 + j * 17) % 41 - 20) / 50.0 for j in range(64)] for i in range(8)]


@register(f"""
WITH c AS (SELECT unnest(range(8)) AS k, unnest({_CENTRES}) AS c),
d AS (SELECT vec_id, k, round(list_sum(list_transform(list_zip(embedding::DOUBLE[], c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) AS d FROM embeddings, c)
SELECT vec_id, k::INTEGER AS type_id FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1
""")
def assign_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest of eight fixed centres of every vector."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return topk.nearest_centre(vectors, F.col("v"), _CENTRES).select("vec_id", "type_id")


_COMPONENTS = [[((i * 13 + j * 29) % 37 - 18) / 40.0 for j in range(64)] for i in range(16)]


@register(f"""
WITH m AS (SELECT unnest(range(16)) AS k, unnest({_COMPONENTS}) AS c),
d AS (SELECT vec_id, k, greatest(-127, least(127, floor(list_sum(list_transform(list_zip(embedding::DOUBLE[], c), lambda z: (z[1] - 0.01) * z[2])) / 0.05 + 0.5)))::INTEGER AS q FROM embeddings, m)
SELECT vec_id, array_to_string(list(q ORDER BY k), ',') AS signature FROM d GROUP BY vec_id
""")
def signature_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen quantised projections of every vector."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    signature = topk.project(F.col("v"), [0.01] * 64, _COMPONENTS, [0.05] * 16)
    return vectors.select("vec_id", F.array_join(signature.cast("array<string>"), ",").alias("signature"))


@register("""
WITH s AS (SELECT l_suppkey, l_returnflag AS source, sum(l_quantity) AS weight FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, source, weight, round(weight / sum(weight) OVER (PARTITION BY l_suppkey), 9) AS share,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY weight DESC, source) = 1 AS dominant FROM s
""")
def weighted_share_dominant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each return flag in a supplier's quantity, and the dominant one."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_returnflag").alias("source"), "l_quantity")
    return stats.share_by(rows, "source", "l_quantity", ["l_suppkey"]).withColumn("share", F.round("share", 9))


@register("""
SELECT CASE WHEN grouping(l_returnflag) = 1 THEN NULL ELSE l_returnflag END AS first, l_linestatus AS second, grouping(l_returnflag, l_linestatus)::INTEGER AS level,
  round(avg(l_discount), 9) AS mean, count(l_discount) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)
""")
def grouping_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean discount by flag, status, both and over all."""
    return stats.grouping_report(table(spark, sf_dir, "lineitem"), "l_discount", "l_returnflag", "l_linestatus").withColumn("mean", F.round("mean", 9))


@register("""
WITH g AS (SELECT l_returnflag, l_suppkey, avg(l_tax) AS m, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, round(sum(m * n) / sum(n), 9) AS mean, sum(n)::BIGINT AS n FROM g GROUP BY 1
""")
def mean_of_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mean of the suppliers' mean taxes."""
    return stats.mean_of_means(table(spark, sf_dir, "lineitem"), "l_tax", "l_suppkey", ["l_returnflag"]).withColumn("mean", F.round("mean", 9))


@register("""
WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS x,
  rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS y FROM part)
SELECT round(corr(x, y), 9) AS rho, count(*) AS n FROM r
""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of size and price."""
    return stats.rank_correlation(table(spark, sf_dir, "part"), "p_size", "p_retailprice").withColumn("rho", F.round("rho", 9))


@register("""
SELECT quality AS band, count(*) FILTER (t AND g) AS tp, count(*) FILTER (NOT t AND g) AS fp, count(*) FILTER (t AND NOT g) AS fn,
  round(count(*) FILTER (t AND g) / nullif(count(*) FILTER (t OR g), 0), 9) AS iou
FROM (SELECT quality, toxic = 1 AS t, doc_id % 4 = 0 AS g FROM labels) GROUP BY 1
""")
def iou_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion of a fixed guess with a label, by band."""
    rows = table(spark, sf_dir, "labels").withColumn("band", F.col("quality"))
    return stats.confusion(rows, F.col("toxic") == 1, F.col("doc_id") % 4 == 0, ["band"]).withColumn("iou", F.round("iou", 9))


@register("""
SELECT least(9, floor(value / 10))::BIGINT AS bin, count(*) AS n, round(avg(value), 6) AS mean, round(avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END), 9) AS rate
FROM events WHERE value >= 0 GROUP BY 1
""")
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value and rate of clicks by decile of value."""
    rows = table(spark, sf_dir, "events").where("value >= 0")
    return rows.groupBy(F.least(F.lit(9), F.floor(F.col("value") / 10)).cast("long").alias("bin")).agg(
        F.count("*").alias("n"),
        F.round(F.avg("value"), 6).alias("mean"),
        F.round(F.avg(F.when(F.col("event_type") == "click", 1.0).otherwise(0.0)), 9).alias("rate"),
    )


@register("""
SELECT user_id, sum((props::JSON ->> '$.k')::BIGINT)::BIGINT AS total, count(*) FILTER (props::JSON ->> '$.k' IS NULL) AS missing FROM events GROUP BY 1
""")
def json_prop_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of a property parsed with a declared schema."""
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(k).alias("total"), F.count(F.when(k.isNull(), 1)).alias("missing"))


@register("""
SELECT event_id, user_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 20
""")
def latest_twenty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's newest twenty events."""
    return sequences.latest(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.col("event_id")], 20).select("event_id", "user_id", "ts")


@register("""
SELECT user_id, event_type, event_id FROM events QUALIFY event_id = max(event_id) OVER (PARTITION BY user_id, event_type)
""")
def newest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest event of every user and type, as the newest revision of a job."""
    jobs = table(spark, sf_dir, "events").select(F.struct("user_id", "event_type").alias("job"), "user_id", "event_type", "event_id")
    return stateful.newest_revision(jobs, "job", "event_id").select("user_id", "event_type", "event_id")


@register()
def rate_limit_accepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three accepted events a user and hour."""
    rows = table(spark, sf_dir, "events").select("user_id", _seconds().alias("t"), "event_id")
    return stateful.rate_limited(rows, "user_id", "t", "event_id", 3, 3600.0)


@register("""
SELECT l_orderkey, round(sum(CASE WHEN s IS NOT NULL THEN s * w ELSE 0 END), 6) AS protected, round(sum(CASE WHEN s IS NOT NULL THEN (1 - s) * w ELSE 0 END), 6) AS exposed,
  round(sum(CASE WHEN s IS NULL THEN w ELSE 0 END), 6) AS unknown, round(sum(CASE WHEN s IS NOT NULL THEN w ELSE 0 END) / nullif(sum(w), 0), 9) AS coverage
FROM (SELECT l_orderkey, CASE WHEN l_partkey % 5 <> 0 THEN l_discount * 10 END AS s, l_quantity AS w FROM lineitem) GROUP BY 1
""")
def exposure_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Protected, exposed and unknown quantity of orders; every fifth part is unknown."""
    share = F.when(F.col("l_partkey") % 5 != 0, F.col("l_discount") * 10)
    out = exposure.weighted_exposure(table(spark, sf_dir, "lineitem"), ["l_orderkey"], share, F.col("l_quantity"))
    return out.select("l_orderkey", *[F.round(c, 6).alias(c) for c in ("protected", "exposed", "unknown")], F.round("coverage", 9).alias("coverage"))


@register("""
WITH r AS (SELECT l_orderkey, CASE WHEN l_partkey % 3 <> 0 THEN l_tax END AS v, l_quantity AS w FROM lineitem)
SELECT l_orderkey, round(sum(w) FILTER (v IS NOT NULL) / sum(w), 9) AS coverage,
  CASE WHEN sum(w) FILTER (v IS NOT NULL) / sum(w) >= 0.6 THEN round(sum(v * w) / sum(w) FILTER (v IS NOT NULL), 9) END AS mean FROM r GROUP BY 1
""")
def wait_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mean where at least 60 percent of the weight is known."""
    value = F.when(F.col("l_partkey") % 3 != 0, F.col("l_tax"))
    out = exposure.gated_mean(table(spark, sf_dir, "lineitem"), ["l_orderkey"], value, F.col("l_quantity"), 0.6)
    return out.select("l_orderkey", F.nullif(F.round(F.coalesce("coverage", F.lit(0.0)), 9), F.lit(0.0)).alias("coverage"), F.round("mean", 9).alias("mean"))


@register("""
WITH s AS (SELECT user_id, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + (event_id % 50) * 60 AS e FROM events),
b AS (SELECT user_id, s, e, unnest(range(s // 900, (e - 1) // 900 + 1)) AS bucket FROM s WHERE e > s)
SELECT user_id, bucket, sum(least(e, (bucket + 1) * 900) - greatest(s, bucket * 900))::BIGINT AS seconds FROM b GROUP BY 1, 2
""")
def stay_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of each stay by quarter hour."""
    start = F.floor(_seconds()).cast("long")
    stays = table(spark, sf_dir, "events").select("user_id", start.alias("s"), (start + (F.col("event_id") % 50) * 60).alias("e"))
    return temporal.bucket_dwell(stays, ["user_id"], "s", "e", 900)


@register("""
WITH f AS (SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, chr(10) ORDER BY c_mktsegment) AS s FROM customer GROUP BY 1)
SELECT c_nationkey, sha256(s) AS fingerprint FROM f
""")
def set_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each nation's set of segments."""
    return clean.fingerprint(table(spark, sf_dir, "customer"), ["c_nationkey"], F.col("c_mktsegment"))


@register("""
WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderkey, (i % 7)::INTEGER AS dealt, floor(((i + 1) * 7 - 1) / n)::INTEGER AS cut FROM r
""")
def shard_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round-robin and contiguous shards of orders by priority."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    dealt = clean.round_robin(orders, ["o_orderkey"], 7, ["o_orderpriority"]).withColumnRenamed("shard", "dealt")
    return clean.contiguous(dealt, ["o_orderkey"], 7, ["o_orderpriority"]).select("o_orderkey", "dealt", F.col("shard").alias("cut"))


@register("""
WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
want AS (SELECT DISTINCT p_brand, floor(k * n / 10)::BIGINT AS i FROM r, range(10) t(k))
SELECT p_brand, p_partkey FROM r SEMI JOIN want USING (p_brand, i)
""")
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten parts of every brand at even steps (a sampling operator)."""
    return clean.even_sample(table(spark, sf_dir, "part").select("p_brand", "p_partkey"), ["p_partkey"], 10, ["p_brand"])
