"""Joins on time: nearest instant, newest valid version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_in_time(left: DataFrame, right: DataFrame, left_id: str, left_time: Column, right_time: Column, columns: list[str], window: float, required: str | None = None) -> DataFrame:
    """Each left row with the right row nearest in time (seconds) within ``window``, the earlier one on ties.

    Right rows without the ``required`` column don't count. Only different instants meet: times are cut to cells of the window's
    length, inside a cell a window carries the last instant before and the first one after, and each cell gets
    those at the edges of its two neighbours. So work grows with the rows, however many lie within a window.
    """
    a = left.select(left_id, left_time.alias("_t"))
    b = right.where(F.col(required).isNotNull()) if required else right
    cell = F.floor(F.col("_t") / window).cast("long")
    # Of right rows of one instant the smallest stands for all.
    there = b.select(right_time.alias("_t"), F.struct(right_time.alias("right_time"), *columns).alias("_r")).where("_t is not null")
    there = there.groupBy("_t").agg(F.min("_r").alias("_r"))
    asked = a.where("_t is not null").select("_t").distinct()
    instants = there.withColumn("_asked", F.lit(False)).unionByName(asked.withColumn("_asked", F.lit(True)), allowMissingColumns=True)
    instants = instants.groupBy("_t").agg(F.max("_r").alias("_r"), F.max("_asked").alias("_asked")).withColumn("_cell", cell)
    edges = there.groupBy(cell.alias("_cell")).agg(F.min("_r").alias("_first"), F.max("_r").alias("_last"))
    on = lambda order: F.last("_r", True).over(Window.partitionBy("_cell").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    near = (
        instants.withColumn("_before", on(F.asc("_t")))
        .withColumn("_after", on(F.desc("_t")))
        .where("_asked")
        .join(edges.select((F.col("_cell") + 1).alias("_cell"), F.col("_last").alias("_left")), "_cell", "left")
        .join(edges.select((F.col("_cell") - 1).alias("_cell"), F.col("_first").alias("_right")), "_cell", "left")
    )
    to = lambda r: F.when(F.abs(F.col("_t") - r["right_time"]) <= window, F.struct(F.abs(F.col("_t") - r["right_time"]).alias("away"), r["right_time"].alias("right_time"), *(r[c].alias(c) for c in columns)))
    best = F.array_min(F.array_compact(F.array(*(to(F.col(c)) for c in ("_before", "_after", "_left", "_right")))))
    met = a.join(near.select("_t", best.alias("b")).where("b is not null"), "_t").groupBy(left_id).agg(F.min("b").alias("b"))
    return a.select(left_id).join(met, left_id, "left").select(
        left_id, F.col("b.right_time").alias("right_time"), F.col("b.away").alias("away"), *[F.col(f"b.{c}").alias(c) for c in columns]
    )


def valid_version(versions: DataFrame, key: str, start: str, end: str, recorded: str, instant: Column, value: str) -> DataFrame:
    """For every key the value of the newest version in force at an instant: started, not ended, latest start, then latest record."""
    live = versions.where((F.col(start) <= instant) & (F.col(end).isNull() | (F.col(end) >= instant)))
    newest = F.max(F.struct(F.col(start).alias("s"), F.col(recorded).alias("r"), F.col(value).alias("v")))
    return live.groupBy(key).agg(newest.alias("n")).select(key, F.col("n.s").alias(start), F.col("n.v").alias(value))


def bucket_dwell(df: DataFrame, keys: list[str], start: str, end: str, size: int) -> DataFrame:
    """Seconds of each stay in every bucket of ``size`` seconds that it touches."""
    first, last = F.floor(F.col(start) / size), F.floor((F.col(end) - 1) / size)
    parts = df.where(F.col(end) > F.col(start)).withColumn("bucket", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    inside = F.least(F.col(end), (F.col("bucket") + 1) * size) - F.greatest(F.col(start), F.col("bucket") * size)
    return parts.groupBy(*keys, "bucket").agg(F.sum(inside).alias("seconds"))
