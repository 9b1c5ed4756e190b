"""Queries on scalar rules: heat, sun dose, rain, travel cost, clocks and confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penumbra.functions import clock, exposure
from penumbra.plans.registry import register
from penumbra.session import table


@register("""
WITH f AS (SELECT event_id, value / 2 AS felt FROM events),
s AS (SELECT event_id, CASE WHEN felt <= 9 THEN 0.0 WHEN felt <= 26 THEN (felt - 9) / 17 * 40 WHEN felt <= 32 THEN 40 + (felt - 26) / 6 * 20
  WHEN felt <= 38 THEN 60 + (felt - 32) / 6 * 20 WHEN felt <= 46 THEN 80 + (felt - 38) / 8 * 20 WHEN felt IS NOT NULL THEN 100.0 END AS score FROM f)
SELECT event_id, round(score, 6) AS score, CASE WHEN score < 40 THEN 'no heat stress' WHEN score < 60 THEN 'moderate heat stress' WHEN score < 80 THEN 'strong heat stress'
  WHEN score < 100 THEN 'very strong heat stress' WHEN score IS NOT NULL THEN 'extreme heat stress' END AS band FROM s
""")
def heat_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heat score and band of event values read as felt temperatures."""
    score = exposure.felt_score(F.col("value") / 2)
    return table(spark, sf_dir, "events").select("event_id", F.round(score, 6).alias("score"), exposure.heat_band(score).alias("band"))


@register("""
WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity / 5 * 0.015 AS m, l_discount * 100 AS sun, l_tax * 100 AS shade FROM lineitem),
r AS (SELECT *, m * (sun + shade * 0.2) AS low, m * (sun + shade * 0.6) AS high FROM d)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(low, 6) AS low, round(high, 6) AS high,
  CASE WHEN high = 0 THEN 'low' WHEN high / low <= 1.6 THEN 'low' WHEN high / low <= 2.6 THEN 'medium' ELSE 'high' END AS uncertainty FROM r
""")
def uv_dose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sun dose of lines read as trips."""
    dose = exposure.sun_dose(F.col("l_quantity") / 5, F.col("l_discount") * 100, F.col("l_tax") * 100)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", dose.alias("d"))
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("d.low", 6).alias("low"), F.round("d.high", 6).alias("high"), F.col("d.uncertainty").alias("uncertainty")
    )


@register("""
SELECT event_id, round(greatest(10, least(89.5, 90 - degrees(atan(greatest(0, value / 5) / 9)))), 6) AS altitude,
  (['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'])[(floor((event_id % 360) / 45.0 + 0.5)::INTEGER % 8) + 1] AS wind,
  round(CASE WHEN event_id % 4 = 0 THEN 1.0 ELSE 0.1 + greatest(0, least(1, (value / 100 - 0.3) / 0.6)) * 0.3 END, 9) AS opacity FROM events
""")
def rain_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angle of rain, compass point and rain opacity."""
    light = F.when(F.col("event_id") % 4 != 0, F.col("value") / 100)
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.round(exposure.rain_angle(F.col("value") / 5), 6).alias("altitude"),
        exposure.compass((F.col("event_id") % 360).cast("double")).alias("wind"),
        F.round(exposure.rain_opacity(light), 9).alias("opacity"),
    )


@register("""
WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS m, CASE WHEN l_partkey % 9 = 0 THEN 'steps' WHEN l_partkey % 9 = 1 THEN 'cycleway' ELSE 'footway' END AS hw,
  l_partkey % 5 = 0 AS rough, CASE l_partkey % 4 WHEN 0 THEN 'good' WHEN 1 THEN 'intermediate' WHEN 2 THEN 'bad' END AS sm FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, m AS walk,
  greatest(1, m + CASE WHEN hw = 'steps' THEN 500 ELSE 0 END + CASE WHEN rough THEN 75 ELSE 0 END - CASE WHEN hw = 'cycleway' THEN least(40, m * 0.5) ELSE 0 END) AS bike,
  greatest(1, m + CASE WHEN sm = 'good' THEN 0 WHEN sm = 'intermediate' THEN 50 WHEN sm = 'bad' OR rough THEN 1000 ELSE 0 END) AS scoot,
  round((m + CASE WHEN hw = 'steps' THEN 500 ELSE 0 END) / 4.5, 6) AS bike_sec FROM e
""")
def mode_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of lines read as edges, by mode."""
    part = F.col("l_partkey")
    highway = F.when(part % 9 == 0, "steps").when(part % 9 == 1, "cycleway").otherwise("footway")
    smooth = F.when(part % 4 == 0, "good").when(part % 4 == 1, "intermediate").when(part % 4 == 2, "bad")
    cost = {m: exposure.mode_metres(m, F.col("l_quantity"), highway, part % 5 == 0, smooth, highway == "cycleway") for m in exposure.MODES}
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[c.alias(m) for m, c in cost.items()], F.round(exposure.mode_seconds("bike", F.col("l_quantity"), highway), 6).alias("bike_sec")
    )


@register("""
WITH c AS (SELECT event_id, (['tiles', 'overpass', 'static', 'canopy', 'raster', 'shed'])[event_id % 6 + 1] AS source, value / 4 AS alt, event_id % 3 AS prisms, (value % 10) / 8 AS done FROM events)
SELECT event_id, source, round(CASE source WHEN 'tiles' THEN 0.8 WHEN 'overpass' THEN 0.7 WHEN 'static' THEN 0.75 WHEN 'canopy' THEN 0.35 WHEN 'raster' THEN 0.45 ELSE 0.3 END
  * CASE WHEN alt >= 10 THEN 1 ELSE 0.3 + greatest(0, alt / 10) * 0.7 END * CASE WHEN prisms > 0 THEN 1 ELSE 0.4 END * greatest(0, least(1, done)) + 1e-9, 6) AS confidence FROM c
""")
def shade_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of shade readings by source, sun and geometry."""
    source = F.element_at(F.array(*map(F.lit, exposure.CONFIDENCE)), (F.col("event_id") % 6 + 1).cast("int"))
    value = exposure.confidence(source, F.col("value") / 4, F.col("event_id") % 3, (F.col("value") % 10) / 8)
    return table(spark, sf_dir, "events").select("event_id", source.alias("source"), F.round(value + 1e-9, 6).alias("confidence"))


@register("""
WITH t AS (SELECT event_id, month(ts) AS m, hour(ts) * 60 + minute(ts) AS mins, value / 100 AS f FROM events)
SELECT event_id, ((m - 1) * 64 + greatest(0, least(63, floor((mins - 300) / 15.0 + 0.5))))::INTEGER AS slot, greatest(0, least(255, floor(f * 255.0 + 0.5)))::INTEGER AS byte,
  CASE WHEN m BETWEEN 4 AND 10 THEN 0.9 ELSE 0.3 END::DOUBLE AS crown FROM t
""")
def shade_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot of the shade table, byte and crown opacity of events read as samples."""
    minutes = F.hour("ts") * 60 + F.minute("ts")
    return table(spark, sf_dir, "events").select(
        "event_id",
        clock.slot_index(F.month("ts") - 1, minutes).alias("slot"),
        clock.fraction_byte(F.col("value") / 100).alias("byte"),
        exposure.crown_opacity(F.month("ts"), F.lit(40.7)).alias("crown"),
    )


@register("""
WITH t AS (SELECT o_orderkey, (o_orderkey % 30)::VARCHAR || ':' || lpad((o_orderkey % 60)::VARCHAR, 2, '0') || ':' || lpad((o_orderkey % 61)::VARCHAR, 2, '0') AS s, o_orderdate::DATE AS d, hour(o_orderdate) AS h FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 61 < 60 THEN (o_orderkey % 30) * 3600 + (o_orderkey % 60) * 60 + o_orderkey % 61 END::INTEGER AS sec,
  CASE WHEN isodow(d) < 6 THEN 'weekday' WHEN isodow(d) = 6 THEN 'saturday' ELSE 'sunday' END AS kind FROM t
""")
def service_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service seconds of texts past midnight, and day types."""
    k = F.col("o_orderkey")
    text = F.concat_ws(":", (k % 30).cast("string"), F.lpad((k % 60).cast("string"), 2, "0"), F.lpad((k % 61).cast("string"), 2, "0"))
    return table(spark, sf_dir, "orders").select("o_orderkey", clock.service_seconds(text).alias("sec"), clock.day_type(F.to_date("o_orderdate")).alias("kind"))


@register("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(-ln(1 + exp(-z)), 9) AS logp FROM (
  SELECT *, -(((l_quantity - 25) * 10) / 100 * 1.2 + ((l_discount - 0.05) * 1000) / 100) AS z FROM lineitem)
""")
def choice_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of picks read from lines."""
    z = exposure.chosen_logit((F.col("l_quantity") - 25) * 10, (F.col("l_discount") - 0.05) * 1000, 1.2)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(-F.log(1 + F.exp(-z)), 9).alias("logp"))
