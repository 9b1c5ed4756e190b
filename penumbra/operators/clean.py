"""Rejecting, imputing, deduplicating and verifying rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penumbra.operators.stats import number_rows, percentile_linear

def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that a row breaks; null if it breaks none. An unknown condition counts as kept."""
    out = None
    for name, broken in rules:
        out = F.when(broken, name) if out is None else out.when(broken, name)
    return out if out is not None else F.lit(None).cast("string")


def reject(df: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Rows that break no rule, and how many rows each rule takes out first."""
    judged = df.withColumn("reason", first_reason(rules))
    counts = judged.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))
    return judged.where("reason is null").drop("reason"), counts


def impute_median(df: DataFrame, value: str, group: str, fallback: float) -> DataFrame:
    """Missing values as the group's median, else the median of all, else ``fallback``; ``<value>_source`` says which."""
    medians = percentile_linear(df, value, [group], {"_group": 50})
    overall = percentile_linear(df, value, [], {"_all": 50})  # one row
    joined = df.join(medians, group, "left").join(F.broadcast(overall), F.lit(True))
    source = (
        F.when(F.col(value).isNotNull(), "measured")
        .when(F.col("_group").isNotNull(), "group_median")
        .when(F.col("_all").isNotNull(), "overall_median")
        .otherwise("fallback")
    )
    return (
        joined.withColumn(f"{value}_source", source)
        .withColumn(value, F.coalesce(value, "_group", "_all", F.lit(fallback)))
        .drop("_group", "_all")
    )


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row a key: the first by the order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def conflicting(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys whose rows disagree in any of the columns."""
    return df.groupBy(key).agg(F.count_distinct(F.struct(*columns)).alias("versions")).where("versions > 1")


def differences(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows that only one side has, counting repeats: ``side`` is ``found`` or ``expected``."""
    return found.exceptAll(expected).withColumn("side", F.lit("found")).unionByName(expected.exceptAll(found).withColumn("side", F.lit("expected")))


def bounds(df: DataFrame, keys: list[str], lon: str, lat: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(lat).alias("south"), F.min(lon).alias("west"), F.max(lat).alias("north"), F.max(lon).alias("east"))


def fingerprint(df: DataFrame, keys: list[str], item: Column) -> DataFrame:
    """SHA-256 of each key's distinct items in order, line by line: equal for equal sets."""
    return df.groupBy(*keys).agg(F.sha2(F.array_join(F.sort_array(F.collect_set(item)), "\n"), 256).alias("fingerprint"))


def round_robin(df: DataFrame, order: list[str], shards: int, keys: list[str]) -> DataFrame:
    """Shard of a row by its place in its key's order."""
    placed = number_rows(df, keys, order, "_i", "_n")
    return placed.withColumn("shard", (F.col("_i") % shards).cast("int")).drop("_i", "_n")


def contiguous(df: DataFrame, order: list[str], shards: int, keys: list[str]) -> DataFrame:
    """Shard i holds the places from floor(i * n / shards) on."""
    placed = number_rows(df, keys, order, "_i", "_n")
    return placed.withColumn("shard", F.floor(((F.col("_i") + 1) * shards - 1) / F.col("_n")).cast("int")).drop("_i", "_n")


def even_sample(df: DataFrame, order: list[str], count: int, keys: list[str]) -> DataFrame:
    """``count`` rows of each key at even steps: the places floor(i * n / count)."""
    marked = number_rows(df, keys, order, "_i", "_n")
    step = F.floor(F.ceil(F.col("_i") * count / F.col("_n")) * F.col("_n") / count)
    return marked.where((step == F.col("_i")) | (F.col("_n") <= count)).drop("_i", "_n")
