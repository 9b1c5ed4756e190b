"""Series by time of day: rollups, comparison of two series, zipped arrays, sun-consistent instants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penumbra.functions.exposure import sun_position


def rollup(df: DataFrame, keys: list[str], minute: str, value: str, width: int = 60) -> DataFrame:
    """Mean and samples by bin of ``width`` minutes."""
    return df.groupBy(*keys, F.floor(F.col(minute) / width).cast("int").alias("bin")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def compare(one: DataFrame, two: DataFrame, keys: list[str]) -> DataFrame:
    """Two rolled-up series side by side; ``partial`` where only one has the bin."""
    a = one.select(*keys, "bin", F.col("mean").alias("mean_a"))
    b = two.select(*keys, "bin", F.col("mean").alias("mean_b"))
    return a.join(b, [*keys, "bin"], "full").withColumn("partial", F.col("mean_a").isNull() | F.col("mean_b").isNull())


def zipped(df: DataFrame, keys: list[str], arrays: list[str]) -> DataFrame:
    """Parallel arrays as rows, with ``position``; a shorter array gives nulls."""
    return df.select(*keys, F.posexplode(F.arrays_zip(*arrays)).alias("position", "_z")).select(*keys, "position", *[F.col(f"_z.{a}").alias(a) for a in arrays])


def best_slot(df: DataFrame, keys: list[str], slot: str, value: Column) -> DataFrame:
    """The slot with the least value, the earliest on ties; unknown values don't count."""
    best = F.min(F.struct(value.alias("v"), F.col(slot).alias("s")))
    return df.where(value.isNotNull()).groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.s").alias(slot), F.col("b.v").alias("value"))


def first_last_change(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Last value less the first, and in percent of the first."""
    ends = df.groupBy(*keys).agg(F.min_by(value, order).alias("a"), F.max_by(value, order).alias("b"))
    return ends.select(*keys, (F.col("b") - F.col("a")).alias("change"), ((F.col("b") - F.col("a")) / F.nullif(F.col("a"), F.lit(0.0)) * 100).alias("percent"))


def proven(results: DataFrame, time: float, sun: float) -> tuple[DataFrame, DataFrame]:
    """From cached results ``edge_id, time_budget, sun_budget, status``: edges proven reachable under budgets no
    larger than the asked ones, and undecided edges less the proven ones."""
    within = (F.col("time_budget") <= time) & (F.col("sun_budget") <= sun)
    sure = results.where(within & (F.col("status") == "reachable")).select("edge_id").distinct()
    open_ = results.where(F.col("status") == "undecided").select("edge_id").distinct().join(sure, "edge_id", "left_anti")
    return sure, open_


def sun_consistent(marks: DataFrame, days: int = 365, step_minutes: int = 10, tolerance: float = 1.0) -> DataFrame:
    """Days and minutes (UTC) at which the sun stands where a photo's marks put it.

    ``marks`` has ``mark_id, lon, lat, azimuth, altitude, year``. Every mark is crossed with the grid of instants,
    which is fixed and small; the test is an expression.
    """
    grid = marks.withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(days - 1)))).withColumn(
        "minute", F.explode(F.sequence(F.lit(0), F.lit(1439), F.lit(step_minutes)))
    )
    start = F.make_timestamp(F.col("year"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0), F.lit("UTC"))
    instant = F.timestamp_micros(F.unix_micros(start) + (F.col("day") * 1440 + F.col("minute")).cast("long") * 60_000_000)
    azimuth, altitude = sun_position(instant, F.col("lon"), F.col("lat"))
    turn = F.abs(F.pmod(azimuth - F.col("azimuth") + 180.0, F.lit(360.0)) - 180.0)
    return grid.where((F.abs(altitude - F.col("altitude")) <= tolerance) & (turn <= tolerance)).select("mark_id", "day", "minute")
