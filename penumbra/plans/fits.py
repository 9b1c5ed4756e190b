"""Queries on zoned instants, the sun's day, the verifier of generations, and fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penumbra.functions import clock
from penumbra.operators import generations, preference, signatures, suntimes
from penumbra.plans.networks import ROW, streets
from penumbra.plans.registry import register
from penumbra.session import cut, shared_path, table

_ZONES = ["America/New_York", "Europe/Madrid", "Asia/Kolkata", "Australia/Lord_Howe", "UTC"]


@register(f"""
WITH p AS (SELECT o_orderkey, {_ZONES!r}[1 + o_orderkey % 5] AS zone, 2024 + o_orderkey % 3 AS y, o_orderkey * 7 % 14 AS m, CASE WHEN o_orderkey % 4 = 0 THEN 8 + o_custkey % 25 ELSE o_custkey % 400 END AS d,
  o_custkey * 5 % 26 AS h, o_orderkey * 11 % 60 AS mi FROM orders),
u AS (SELECT *, (make_date(y, 1, 1) + to_months(m::INTEGER) + to_days((d - 1)::INTEGER))::TIMESTAMP + to_minutes(h * 60 + mi) AS ts FROM p),
b AS (SELECT *, date_diff('minute', ts, timezone(zone, timezone('UTC', ts))) AS before FROM u),
c AS (SELECT *, ts - to_minutes(before) AS guess FROM b)
SELECT o_orderkey, epoch(ts - to_minutes(date_diff('minute', guess, timezone(zone, timezone('UTC', guess)))))::BIGINT AS seconds FROM c
""")
def zoned_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock readings of the orders in five zones as instants, many of them about the days on which clocks change."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    zone = F.get(F.array(*map(F.lit, _ZONES)), (o % 5).cast("int"))
    day = F.when(o % 4 == 0, 8 + c % 25).otherwise(c % 400).cast("int")
    when = clock.instant_of(zone, (2024 + o % 3).cast("int"), (o * 7 % 14).cast("int"), day, c * 5 % 26, o * 11 % 60)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.unix_seconds(when).alias("seconds"))


_PLACES = """pl AS (SELECT c_custkey AS c, ((c_custkey * 7919) % 3600) / 10.0::DOUBLE - 180 AS lon, (c_custkey % 33) * 5.0::DOUBLE - 80 AS lat,
  epoch(make_timestamp(2026, 1, 1, 0, 0, 0.0)) + (c_custkey * 37 % 365) * 86400 + (c_custkey % 24) * 3600 AS t FROM customer),
nn AS (SELECT *, floor((t + lon * 240) / 86400) * 86400 + 43200 - lon * 240 AS noon FROM pl)"""


def _altitude(rows: str) -> str:
    return f"""d1 AS (SELECT *, (noon + m * 60) / 86400 - 10957.5 AS d FROM {rows}),
d2 AS (SELECT *, radians(((d * 0.98560028 + 357.528) % 360 + 360) % 360) AS g, radians(23.439 - d * 4e-7) AS tilt FROM d1),
d3 AS (SELECT *, radians(((d * 0.9856474 + 280.460) % 360 + 360) % 360 + sin(g) * 1.915 + sin(g * 2) * 0.020) AS e, radians(((d * 360.98564736629 + 280.46061837 + lon) % 360 + 360) % 360) AS sid, radians(lat) AS phi FROM d2),
d4 AS (SELECT *, asin(sin(tilt) * sin(e)) AS dec, sid - atan2(cos(tilt) * sin(e), cos(e)) AS hour FROM d3),
alt AS (SELECT c, noon, m, degrees(asin(sin(phi) * sin(dec) + cos(phi) * cos(dec) * cos(hour))) AS a FROM d4)"""


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    begin = 1767225600  # 2026 begins
    instant = F.timestamp_seconds(begin + c * 37 % 365 * 86400 + c % 24 * 3600)
    return table(spark, sf_dir, "customer").select("c_custkey", (c * 7919 % 3600 / 10.0 - 180).alias("lon"), (c % 33 * 5.0 - 80).alias("lat"), instant.alias("instant"))


@register(f"""
WITH {_PLACES}, {_altitude("(SELECT *, unnest(range(-720, 721)) AS m FROM nn)")},
p AS (SELECT c, noon, m, a, lead(a) OVER (PARTITION BY c ORDER BY m) AS b FROM alt),
x AS (SELECT c, b >= -0.833 AS up, noon, m + (-0.833 - a) / (b - a) AS dist FROM p WHERE b IS NOT NULL AND (a < -0.833) <> (b < -0.833)),
s AS (SELECT c, max(CASE WHEN up AND dist <= 0 THEN noon + dist * 60 END) AS r, min(CASE WHEN NOT up AND dist >= 0 THEN noon + dist * 60 END) AS s FROM x GROUP BY 1)
SELECT c_custkey, CASE WHEN s IS NOT NULL THEN round(r) END::BIGINT AS sunrise, CASE WHEN r IS NOT NULL THEN round(s) END::BIGINT AS sunset FROM customer LEFT JOIN s ON c = c_custkey
""")
def sun_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sunrise and sunset, to the second, of customers all over the globe on days all over a year; none on polar days and nights."""
    found = suntimes.passages(_places(spark, sf_dir), "c_custkey")
    both = F.col("up_at").isNotNull() & F.col("down_at").isNotNull()
    second = lambda c, name: F.when(both, F.round(c)).cast("long").alias(name)
    return found.select("c_custkey", second("up_at", "sunrise"), second("down_at", "sunset"))


@register(f"""
WITH {_PLACES}, {_altitude("(SELECT *, unnest(range(-720, 721, 15)) AS m FROM nn)")},
w AS (SELECT c, least(720, greatest(-720, c * 17 % 1500 - 750)) AS want FROM nn),
p AS (SELECT c, m, a, lead(a) OVER (PARTITION BY c ORDER BY m) AS b FROM alt)
SELECT c AS c_custkey, round(a + (b - a) * (want - m) / 15, 6) AS altitude FROM p JOIN w USING (c) WHERE b IS NOT NULL AND want >= m AND (want < m + 15 OR (want = 720 AND m = 705))
""")
def altitude_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sun's altitude at a minute of every customer's day, between the samples of a quarter-hour trace."""
    rows = suntimes.altitudes_at(_places(spark, sf_dir), "c_custkey", F.col("c_custkey") * 17 % 1500 - 750)
    return rows.select("c_custkey", F.round("altitude", 6).alias("altitude"))


@register("""
WITH k AS (SELECT DISTINCT c_custkey // 100 AS k FROM customer), n AS (SELECT *, 's' || lpad(k::VARCHAR, 6, '0') AS shard, k % 5 <> 0 AS claimed FROM k)
SELECT 'zzz' AS shard, 'missing' AS fault UNION ALL SELECT shard, 'unclaimed' FROM n WHERE NOT claimed
UNION ALL SELECT shard, 'length' FROM n WHERE claimed AND k % 11 = 2 UNION ALL SELECT shard, 'digest' FROM n WHERE claimed AND k % 11 = 3
UNION ALL SELECT shard, 'nodes' FROM n WHERE claimed AND k % 11 = 4 UNION ALL SELECT shard, 'edges' FROM n WHERE claimed AND k % 11 = 6
UNION ALL SELECT shard, 'bounds' FROM n WHERE claimed AND k % 11 = 1 UNION ALL SELECT shard, 'conflict' FROM n WHERE k - 1 IN (SELECT k FROM n WHERE k % 7 = 2)
UNION ALL SELECT shard, 'dangling' FROM n WHERE k % 7 = 3 OR (k % 7 = 2 AND k + 1 NOT IN (SELECT k FROM n) AND false)
UNION ALL SELECT shard, 'unsorted' FROM n WHERE k % 7 = 4 AND (SELECT count(*) FROM customer WHERE c_custkey // 100 = k) > 1 UNION ALL SELECT shard, 'unreadable' FROM n WHERE k % 7 = 5
""".replace(" OR (k % 7 = 2 AND k + 1 NOT IN (SELECT k FROM n) AND false)", ""))
def generation_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generation of street shards over all customers, written with faults of every kind in some shards and in the manifest, and what the
    verifier finds."""
    c = F.col("c_custkey")
    name = lambda k: F.concat(F.lit("s"), F.lpad(F.floor(k / 100).cast("string"), 6, "0"))
    number = lambda: F.substring("shard", 2, 6).cast("int")
    place = [(F.lit(-74.0) + c % ROW * 0.0008).alias("lon"), (F.lit(40.5) + F.floor(c / ROW) * 0.0006).alias("lat")]
    nodes = table(spark, sf_dir, "customer").select(name(c).alias("shard"), c.alias("id"), *place)
    # Some shards hold the first node of the next shard too, elsewhere; some have an edge to nowhere.
    strays = nodes.groupBy("shard").agg(F.min("id").alias("id")).where((number() % 7 == 3) & (number() > 0))
    strays = strays.select(name(F.floor(F.col("id") / 100) * 100 - 100).alias("shard"), "id", F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat")).join(nodes.select("shard").distinct(), "shard", "left_semi")
    edges = streets(spark, sf_dir).select(name(F.col("from_id")).alias("shard"), F.col("from_id").alias("from"), F.col("to_id").alias("to"))
    bad = nodes.where(number() % 7 == 3).groupBy("shard").agg(F.min("id").alias("from")).select("shard", "from", F.lit(-1).cast("long").alias("to"))
    lines = generations.shard_lines(nodes.union(strays), edges.union(bad))
    lines = lines.withColumn("_key", F.when((number() % 7 == 4) & (F.col("_part") == 0), -F.col("_key")).otherwise(F.col("_key")))
    torn = nodes.where(number() % 7 == 5).select("shard").distinct().select("shard", F.lit(2).alias("_part"), F.lit(0).cast("long").alias("_key"), F.lit("{torn").alias("line"))
    folder = shared_path(spark, "generation")
    generations.write_shards(lines.union(torn), folder)
    files = cut(generations.read_files(spark, folder))  # the many small files are read once
    k = number() % 11
    claimed = generations.manifest(files).where(number() % 5 != 0)
    claimed = claimed.withColumn("bytes", F.col("bytes") + F.when(k == 2, 1).otherwise(0)).withColumn("sha256", F.when(k == 3, F.reverse("sha256")).otherwise(F.col("sha256")))
    claimed = claimed.withColumn("nodes", F.col("nodes") + F.when(k == 4, 1).otherwise(0)).withColumn("edges", F.col("edges") + F.when(k == 6, 1).otherwise(0)).withColumn("west", F.col("west") - F.when(k == 1, 1e-9).otherwise(0.0))
    gone = spark.createDataFrame([("zzz", 1, "", 1, 0, 0.0, 0.0, 0.0, 0.0)], claimed.schema)
    return generations.verify(files, claimed.union(gone))


@register()
def signature_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four types in eight components of all embeddings: each type's rows, and the share of variance that the components explain."""
    model = signatures.fit(table(spark, sf_dir, "embeddings"), "embedding", 8, 4, "vec_id", starts=2, rounds=12)
    share = float(model.explained.sum())
    return spark.createDataFrame([(i, int(n), round(share, 6)) for i, n in enumerate(model.sizes)], "type_id int, members long, explained double")


_GRID = preference.quadrature(16)
_POINT = preference.Hyper(2.5, 2.0, 0.4, 0.6)


@register(f"""
WITH t AS (SELECT o_custkey AS u, ((o_orderkey * 7919 % 2001) - 1000) / 500.0::DOUBLE AS sun, ((o_orderkey * 104729 % 401) - 200) / 500.0::DOUBLE AS tree, ((o_orderkey * 31 % 1001) - 500) / 500.0::DOUBLE AS sh, (o_orderkey // 3) % 2 AS y FROM orders),
q AS (SELECT unnest({[x for x, _ in _GRID]}) AS x, unnest({[w for _, w in _GRID]}) AS w),
z AS (SELECT u, x, w, CASE WHEN y = 1 THEN 1 ELSE -1 END * (x * (sun + {_POINT.rho} * tree) + sh + (1 - {_POINT.rho}) * tree) / {_POINT.tau} AS m FROM t, q),
s AS (SELECT u, x, sum(-(greatest(m, 0) + ln(1 + exp(-abs(m))))) + {_POINT.shape} * ln({_POINT.rate}) - lgamma({_POINT.shape}) + ({_POINT.shape} - 1) * ln(x) - {_POINT.rate} * x + any_value(w) AS v FROM z GROUP BY u, x),
b AS (SELECT u, max(v) AS top FROM s GROUP BY 1)
SELECT u AS o_custkey, round(any_value(top) + ln(sum(exp(v - top))), 6) AS log_m, round(sum(exp(v - top) * x) / sum(exp(v - top)), 6) AS weight FROM s JOIN b USING (u) GROUP BY u
""")
def choice_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as people and orders as their choices: log-likelihood with the weight of sun integrated out, and its mean given them."""
    o = F.col("o_orderkey")
    gap = lambda k, n: (o * k % (2 * n + 1) - n) / F.lit(500.0)
    rows = table(spark, sf_dir, "orders").select("o_custkey", gap(7919, 1000).alias("sun_gap"), gap(104729, 200).alias("tree_gap"), gap(31, 500).alias("shade_gap"), (F.floor(o / 3) % 2).alias("picked"))
    found = preference.marginals(rows, "o_custkey", [_POINT], 16)
    return found.select("o_custkey", F.round("log_m", 6).alias("log_m"), F.round("weight", 6).alias("weight"))
