"""Exposure of legs and routes from sampled segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weighted_exposure(df: DataFrame, keys: list[str], share: Column, weight: Column) -> DataFrame:
    """Protected, exposed and unknown weight, and the known part; an unknown share is never counted as exposed."""
    rows = df.select(*keys, share.alias("s"), weight.alias("w"))
    return rows.groupBy(*keys).agg(
        F.sum(F.when(F.col("s").isNotNull(), F.col("s") * F.col("w")).otherwise(0.0)).alias("protected"),
        F.sum(F.when(F.col("s").isNotNull(), (1 - F.col("s")) * F.col("w")).otherwise(0.0)).alias("exposed"),
        F.sum(F.when(F.col("s").isNull(), F.col("w")).otherwise(0.0)).alias("unknown"),
        (F.sum(F.when(F.col("s").isNotNull(), F.col("w")).otherwise(0.0)) / F.nullif(F.sum("w"), F.lit(0.0))).alias("coverage"),
    )


def gated_mean(df: DataFrame, keys: list[str], value: Column, weight: Column, least: float) -> DataFrame:
    """Weighted mean over known values, null where less than ``least`` of the weight is known."""
    rows = df.select(*keys, value.alias("v"), weight.alias("w"))
    known = F.sum(F.when(F.col("v").isNotNull(), F.col("w")).otherwise(0.0))
    coverage = known / F.nullif(F.sum("w"), F.lit(0.0))
    mean = F.sum(F.col("v") * F.col("w")) / F.nullif(known, F.lit(0.0))
    return rows.groupBy(*keys).agg(coverage.alias("coverage"), F.when(coverage >= least, mean).alias("mean"))


def tag_metres(df: DataFrame, keys: list[str], tag: str, metres: str) -> DataFrame:
    """Metres by tag; a missing tag is ``unknown``."""
    return df.groupBy(*keys, F.coalesce(tag, F.lit("unknown")).alias(tag)).agg(F.sum(metres).alias("metres"))


def sidewalks(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Each edge as two, with ``side`` and its ``shade``; sides swap where the edge runs against its key order."""
    forward = F.col("from_id") <= F.col("to_id")
    sides = F.array(
        F.struct(F.when(forward, "left").otherwise("right").alias("side"), F.col(left).alias("shade")),
        F.struct(F.when(forward, "right").otherwise("left").alias("side"), F.col(right).alias("shade")),
    )
    return edges.withColumn("_s", F.explode(sides)).select(*[c for c in edges.columns if c not in (left, right)], "_s.side", "_s.shade")
