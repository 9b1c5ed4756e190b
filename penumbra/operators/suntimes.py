"""The sun's altitude over a day: traces, values between their samples, and when the sun rises and sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penumbra.functions import exposure

#: Altitude of the sun's middle, in degrees, at which its upper rim meets the horizon through the air; a fixed value.
RISE_DEG = -0.833
#: Minutes of solar time a degree of longitude; a fixed value.
MINUTES_PER_DEGREE = 4.0
#: More degrees a minute than the sun's altitude ever changes by: the earth turns by 0.2507, the sun itself moves by less than 0.001.
MOST_DEG_A_MINUTE = 0.26


def solar_noon(instant: Column, lon: Column) -> Column:
    """Seconds since 1970 of the mean solar noon of the solar day that holds the instant at a longitude."""
    shift = lon * MINUTES_PER_DEGREE * 60
    solar = F.unix_micros(instant) / 1e6 + shift
    return F.floor(solar / 86400) * 86400 + 43200 - shift


def traces(places: DataFrame, id_col: str, step_minutes: int = 15) -> DataFrame:
    """``(id_col), noon, trace``: altitudes at every step from twelve hours before to twelve hours after noon, as ``at`` (minutes from noon), ``altitude``.

    ``places`` has ``instant, lon, lat``.
    """
    noon = places.select(id_col, "lon", "lat", solar_noon(F.col("instant"), F.col("lon")).alias("noon"))
    spread = noon.withColumn("at", F.explode(F.sequence(F.lit(-720), F.lit(720), F.lit(step_minutes))))
    _, altitude = exposure.sun_position(F.timestamp_micros(((F.col("noon") + F.col("at") * 60) * 1e6).cast("long")), F.col("lon"), F.col("lat"))
    rows = spread.select(id_col, "noon", "at", altitude.alias("altitude"))
    return rows.groupBy(id_col, "noon").agg(F.sort_array(F.collect_list(F.struct("at", "altitude"))).alias("trace"))


def value_at(trace: Column, minutes: Column) -> Column:
    """The altitude at a minute, on the straight line between the samples around it; that of the ends beyond them."""
    after = F.filter(trace, lambda p: p["at"] >= minutes)
    before = F.filter(trace, lambda p: p["at"] < minutes)
    a, b = F.try_element_at(before, F.lit(-1)), F.get(after, F.lit(0))
    between = a["altitude"] + (b["altitude"] - a["altitude"]) * (minutes - a["at"]) / (b["at"] - a["at"])
    return F.when(a.isNull(), b["altitude"]).when(b.isNull(), a["altitude"]).otherwise(between)


def altitudes_at(places: DataFrame, id_col: str, minutes: Column, step_minutes: int = 15) -> DataFrame:
    """``(id_col), altitude``: ``value_at`` of every place's trace at a minute, which needs only the two samples around it and no trace."""
    last = 720 // step_minutes * step_minutes * 2 - 720
    rows = places.select(id_col, "lon", "lat", solar_noon(F.col("instant"), F.col("lon")).alias("noon"), minutes.cast("double").alias("want"))
    rows = rows.withColumn("b", F.least(F.greatest(F.ceil((F.col("want") + 720) / step_minutes) * step_minutes - 720, F.lit(-720)), F.lit(last)).cast("int"))
    rows = rows.withColumn("a", F.greatest(F.when(F.col("want") > F.col("b"), F.col("b")).otherwise(F.col("b") - step_minutes), F.lit(-720)))

    def sample(at: str) -> Column:
        return exposure.sun_position(F.timestamp_micros(((F.col("noon") + F.col(at) * 60) * 1e6).cast("long")), F.col("lon"), F.col("lat"))[1]

    rows = rows.withColumns({"_a": sample("a"), "_b": sample("b")})
    between = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("want") - F.col("a")) / F.nullif(F.col("b") - F.col("a"), F.lit(0))
    return rows.select(id_col, F.when(F.col("a") == F.col("b"), F.col("_b")).otherwise(between).alias("altitude"))


def _sign_changes(rows: DataFrame, keys: list[str], level: float) -> DataFrame:
    """``keys, up, low, high, low_value, high_value``: the neighbouring samples between which the altitude passes the level."""
    pairs = F.zip_with(F.slice("trace", 1, F.size("trace") - 1), F.slice("trace", 2, F.size("trace") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    passing = F.filter(pairs, lambda p: (p["a"]["altitude"] < level) != (p["b"]["altitude"] < level))
    return rows.select(*keys, F.explode(passing).alias("p")).select(
        *keys, (F.col("p.b.altitude") >= level).alias("up"), F.col("p.a.at").alias("low"), F.col("p.b.at").alias("high"), F.col("p.a.altitude").alias("low_value"), F.col("p.b.altitude").alias("high_value")
    )


def _near_passages(rows: DataFrame, keys: list[str], level: float) -> DataFrame:
    """``keys, low, high``: the neighbouring samples between which the altitude may pass the level, if only to turn and pass it again."""
    pairs = F.zip_with(F.slice("trace", 1, F.size("trace") - 1), F.slice("trace", 2, F.size("trace") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    near = lambda p: F.abs(p["a"]["altitude"] - level) + F.abs(p["b"]["altitude"] - level) <= (p["b"]["at"] - p["a"]["at"]) * MOST_DEG_A_MINUTE
    passing = F.filter(pairs, lambda p: ((p["a"]["altitude"] < level) != (p["b"]["altitude"] < level)) | near(p))
    return rows.select(*keys, F.explode(passing).alias("p")).select(*keys, F.col("p.a.at").alias("low"), F.col("p.b.at").alias("high"))


def passages(places: DataFrame, id_col: str, level: float = RISE_DEG) -> DataFrame:
    """``(id_col), up_at, down_at``: of every place's solar day the last passage upwards before noon and the first one down after it, in
    seconds since 1970; null where there is none.

    The day's trace tells the quarter hours in which the altitude can pass the level, also twice between two samples of one side, as where
    the sun grazes the horizon; a second trace brackets every passage within a minute, and it is put on the straight line there.
    """
    coarse = _near_passages(traces(places, id_col), [id_col, "noon"], level)
    fine = coarse.join(places.select(id_col, "lon", "lat"), id_col).withColumn("at", F.explode(F.sequence(F.col("low"), F.col("high"))))
    _, altitude = exposure.sun_position_at((F.col("noon") + F.col("at") * 60) / 86400 - 10957.5, F.col("lon"), F.col("lat"))
    rows = fine.select(id_col, "noon", "low", "at", altitude.alias("altitude")).groupBy(id_col, "noon", "low").agg(F.sort_array(F.collect_list(F.struct("at", "altitude"))).alias("trace"))
    found = _sign_changes(rows, [id_col, "noon"], level)
    at = F.col("low") + (F.lit(level) - F.col("low_value")) / (F.col("high_value") - F.col("low_value")) * (F.col("high") - F.col("low"))
    when = F.col("noon") + at * 60
    best = found.groupBy(id_col).agg(F.max(F.when(F.col("up") & (at <= 0), when)).alias("up_at"), F.min(F.when(~F.col("up") & (at >= 0), when)).alias("down_at"))
    return places.select(id_col).join(best, id_col, "left")


def rise_and_set(places: DataFrame, id_col: str, level: float = RISE_DEG) -> DataFrame:
    """``(id_col), sunrise, sunset`` of every place's solar day (``passages``); both null where one of them is missing."""
    found = passages(places, id_col, level)
    both = F.col("up_at").isNotNull() & F.col("down_at").isNotNull()
    instant = lambda c: F.timestamp_micros((F.col(c) * 1e6).cast("long"))
    return found.select(id_col, F.when(both, instant("up_at")).alias("sunrise"), F.when(both, instant("down_at")).alias("sunset"))
