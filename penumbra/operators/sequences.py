"""Operators over ordered rows: runs, islands, sessions, gaps and turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penumbra.functions import geo


def runs(df: DataFrame, keys: list[str], order: list[str], state: Column, length: Column) -> DataFrame:
    """Maximal runs of one state: ``state``, ``length`` and ``rows``. An unknown (null) state ends a run and makes none."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.select(*keys, *order, state.alias("state"), length.alias("length"))
    starts = F.when(F.col("state").eqNullSafe(F.lag("state").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    numbered = marked.withColumn("_new", starts).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        numbered.where("state is not null")
        .groupBy(*keys, "run")
        .agg(F.first("state").alias("state"), F.sum("length").alias("length"), F.count("*").alias("rows"))
    )


def continuity(df: DataFrame, keys: list[str], order: list[str], protected: Column, length: Column) -> DataFrame:
    """Longest protected and exposed runs, known and unknown length, and transitions between neighbours that are both known."""
    w = Window.partitionBy(*keys).orderBy(*order)
    base = df.select(*keys, *order, protected.alias("state"), length.alias("length"))
    before = base.withColumn("_before", F.lag("state").over(w))
    totals = before.groupBy(*keys).agg(
        F.sum(F.when(F.col("state"), F.col("length")).otherwise(0.0)).alias("protected"),
        F.sum(F.when(~F.col("state"), F.col("length")).otherwise(0.0)).alias("exposed"),
        F.sum(F.when(F.col("state").isNull(), F.col("length")).otherwise(0.0)).alias("unknown"),
        F.count(F.when(F.col("state") != F.col("_before"), 1)).alias("transitions"),
    )
    longest = (
        runs(base, keys, order, F.col("state"), F.col("length"))
        .groupBy(*keys)
        .agg(
            F.max(F.when(F.col("state"), F.col("length"))).alias("longest_protected"),
            F.max(F.when(~F.col("state"), F.col("length"))).alias("longest_exposed"),
        )
    )
    zero = F.lit(0.0)
    return totals.join(longest, keys, "left").withColumns(
        {c: F.coalesce(c, zero) for c in ("longest_protected", "longest_exposed")}
    )


def encode_islands(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Runs ``x0`` to ``x1`` of consecutive integers.

    All steps look at neighbours in one order, so a task sorts its rows once and holds no table of them.
    """
    w = Window.partitionBy(*keys).orderBy(x)
    before, after = F.lag(x).over(w), F.lead(x).over(w)
    rows = df.select(*keys, x).where(F.col(x).isNotNull()).withColumn("_b", before).where(F.col("_b").isNull() | (F.col("_b") < F.col(x)))
    ends = rows.withColumns({"_b": before, "_a": after}).withColumns({"_b": F.coalesce(F.col(x) - F.col("_b") > 1, F.lit(True)), "_a": F.coalesce(F.col("_a") - F.col(x) > 1, F.lit(True))})
    # Of the runs' ends in order every beginning is followed by its end, unless it is that too.
    ends = ends.where("_b or _a").withColumn("x1", F.when(F.col("_a"), F.col(x)).otherwise(after))
    return ends.where("_b").select(*keys, F.col(x).alias("x0"), "x1")


def decode_islands(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    return df.select(*keys, F.explode(F.sequence("x0", "x1")).alias(x))


def gap_sessions(df: DataFrame, keys: list[str], time: Column, gap: float) -> DataFrame:
    """Sessions that end where the next row is more than ``gap`` later: first, last and rows of each."""
    rows = df.select(*keys, time.alias("t"))
    w = Window.partitionBy(*keys).orderBy("t")
    new = F.when(F.col("t") - F.lag("t").over(w) <= gap, 0).otherwise(1)
    return (
        rows.withColumn("_new", new)
        .withColumn("session", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "session")
        .agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("rows"))
    )


def neighbours(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Each row with the columns of the row before it as ``prev_*``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({f"prev_{c}": F.lag(c).over(w) for c in columns})


def path_steps(df: DataFrame, keys: list[str], order: list[str], lon: str, lat: str) -> DataFrame:
    """Steps of a polyline: ``metres``, ``bearing``, ``turn`` (against the step before) and ``along`` (metres so far)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    moved = neighbours(df, keys, order, [lon, lat]).where(F.col(f"prev_{lon}").isNotNull())
    args = [F.col(f"prev_{lon}"), F.col(f"prev_{lat}"), F.col(lon), F.col(lat)]
    moved = moved.withColumn("metres", geo.haversine(*args)).withColumn("bearing", geo.bearing(*args))
    return moved.withColumn("turn", geo.bearing_change(F.lag("bearing").over(w), F.col("bearing"))).withColumn(
        "along", F.sum("metres").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )


def turn_counts(df: DataFrame, keys: list[str], order: list[str], lon: str, lat: str, least: float = 30.0) -> DataFrame:
    """Turns of more than ``least`` degrees and the length of each path."""
    return (
        path_steps(df, keys, order, lon, lat)
        .groupBy(*keys)
        .agg(F.count(F.when(F.abs("turn") > least, 1)).alias("turns"), F.sum("metres").alias("metres"))
    )


def maneuvers(df: DataFrame, keys: list[str], order: list[str], lon: str, lat: str) -> DataFrame:
    """Steps whose turn is not straight, with the turn's class and the metres before it."""
    steps = path_steps(df, keys, order, lon, lat).withColumn("kind", geo.turn_class(F.col("turn")))
    return steps.where("turn is not null and kind <> 'straight'").select(*keys, *order, "kind", (F.col("along") - F.col("metres")).alias("at_m"))


def order_violations(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows that repeat their neighbour's order number or whose value runs backwards, counted by key."""
    w = Window.partitionBy(*keys).orderBy(order, value)
    moved = df.withColumn("_o", F.lag(order).over(w)).withColumn("_v", F.lag(value).over(w))
    return moved.groupBy(*keys).agg(
        F.count(F.when(F.col(order) == F.col("_o"), 1)).alias("repeated"), F.count(F.when(F.col(value) < F.col("_v"), 1)).alias("backwards")
    )


def latest(df: DataFrame, keys: list[str], order: list[Column], count: int) -> DataFrame:
    """The ``count`` first rows of each key by the order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= count).drop("_n")


def sign_crossings(df: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Times at which a sampled value changes sign, by linear interpolation between the samples."""
    moved = neighbours(df, keys, [time], [time, value]).where(F.signum(value) * F.signum(f"prev_{value}") < 0)
    share = F.col(f"prev_{value}") / (F.col(f"prev_{value}") - F.col(value))
    return moved.select(*keys, (F.col(f"prev_{time}") + (F.col(time) - F.col(f"prev_{time}")) * share).alias("at"), (F.col(value) > 0).alias("rising"))


def close_versions(df: DataFrame, keys: list[str], start: str) -> DataFrame:
    """Each version with the start of the next one as its end; the newest stays open."""
    return df.withColumn("valid_until", F.lead(start).over(Window.partitionBy(*keys).orderBy(start)))
