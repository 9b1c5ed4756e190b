"""Percentile families, histograms, shares and agreement measures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penumbra.session import cut

#: Ranges of values that a ranking is cut into, and the error allowed to their bounds.
RANGES, RANGE_ERROR = 64, 0.005


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` with the columns of ``right`` by equal keys; null keys are equal."""
    renamed = reduce(lambda d, k: d.withColumnRenamed(k, f"_right_{k}"), keys, right)
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys))
    return left.join(renamed, same, how).drop(*(f"_right_{k}" for k in keys))


def number_rows(df: DataFrame, keys: list[str], order: list[str], place: str, size: str) -> DataFrame:
    """``df`` with each row's place from 0 in its key's order and the key's number of rows.

    Rows are sorted in ranges of key and order, so a hot key lies in several tasks; what the ranges below hold is added.
    """
    columns = [*keys, *order]
    laid = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    laid = cut(laid.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    held = laid.groupBy(*keys, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_held"))
    whole = Window.partitionBy(*keys)
    below = F.sum("_held").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = held.select(*keys, "_part", (F.coalesce(below, F.lit(0)) - F.col("_first")).alias("_offset"), F.sum("_held").over(whole).alias(size))
    placed = join_keys(laid, offsets, [*keys, "_part"]).withColumn(place, F.col("_row") + F.col("_offset"))
    return placed.drop("_part", "_row", "_offset")


def _ranked(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Distinct values with their cumulative counts ``upto`` and group size ``n``.

    Equal values meet first. Values are cut into ranges at approximate quantiles, counted inside
    their range and offset by the ranges below, so that no task sorts a whole group.
    """
    known = df.where(F.col(value).isNotNull())
    bounds = sorted(set(known.approxQuantile(value, [i / RANGES for i in range(1, RANGES)], RANGE_ERROR)))
    limits = F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<double>")
    counted = known.groupBy(*keys, value).agg(F.count("*").alias("c"))
    counted = counted.withColumn("_range", F.size(F.filter(limits, lambda b: b <= F.col(value))))
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    sizes = counted.groupBy(*keys, "_range").agg(F.sum("c").alias("_size"))
    below = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    sizes = sizes.withColumn("_below", F.coalesce(F.sum("_size").over(below), F.lit(0))).withColumn("n", F.sum("_size").over(whole))
    return (
        join_keys(counted.withColumn("_inside", F.sum("c").over(inside)), sizes.drop("_size"), [*keys, "_range"])
        .withColumn("upto", F.col("_inside") + F.col("_below"))
        .drop("_range", "_inside", "_below")
    )


def _at_index(df: DataFrame, value: str, keys: list[str], index: dict[str, Column]) -> DataFrame:
    """The value at zero-based places of the sorted group, a column a place."""
    ranked = _ranked(df, value, keys)
    picks = [F.min(F.when(F.col("upto") > place, F.col(value))).alias(name) for name, place in index.items()]
    return ranked.groupBy(*keys).agg(*picks)


def percentile_nearest_rank(df: DataFrame, value: str, keys: list[str], points: dict[str, float]) -> DataFrame:
    """The value at place ``round(p / 100 * (n - 1))``, halves up; a column a point."""
    return _at_index(df, value, keys, {name: F.floor((F.col("n") - 1) * (p / 100.0) + 0.5) for name, p in points.items()})


def percentile_floor(df: DataFrame, value: str, keys: list[str], points: dict[str, float]) -> DataFrame:
    """The value at place ``floor(f * n)``, at most the last."""
    return _at_index(df, value, keys, {name: F.least(F.col("n") - 1, F.floor(F.col("n") * f)) for name, f in points.items()})


def percentile_linear(df: DataFrame, value: str, keys: list[str], points: dict[str, float]) -> DataFrame:
    """Linear interpolation between the values at the places around ``p / 100 * (n - 1)`` (R-7); null without values.

    The values come from the ranking in ranges: no task holds the values of a whole group.
    """
    ranked = _ranked(df.select(*keys, F.col(value).cast("double").alias("_value")), "_value", keys)
    place = {name: (F.col("n") - 1) * (p / 100.0) for name, p in points.items()}
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col("_value")))
    picks = [pick for name, i in place.items() for pick in (at(F.floor(i)).alias(f"_low_{name}"), at(F.ceil(i)).alias(f"_high_{name}"))]
    found = ranked.groupBy(*keys).agg(F.max("n").alias("n"), *picks)
    out = []
    for name, i in place.items():
        low, high = F.col(f"_low_{name}"), F.col(f"_high_{name}")
        out.append(F.when(low == high, low).otherwise((F.ceil(i) - i) * low + (i - F.floor(i)) * high).alias(name))
    found = found.select(*keys, *out)
    return join_keys(df.select(*keys).distinct(), found, keys, "left") if keys else found


def summary(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Count, mean, median, 90th percentile and worst."""
    return _beside(
        df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("worst")),
        percentile_linear(df, value, keys, {"p50": 50, "p90": 90}),
        keys,
    ).select(*keys, "n", "mean", "p50", "p90", "worst")


def _beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Two tables of one row a key as one; without keys each has one row."""
    return join_keys(left, right, keys) if keys else join_keys(left.withColumn("_one", F.lit(1)), right.withColumn("_one", F.lit(1)), ["_one"]).drop("_one")


def spread_percent(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Least, median and 95th percentile, greatest, and half the 5 to 95 spread in percent of the median."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("least"), F.max(value).alias("most"))
    out = _beside(ends, percentile_linear(df, value, keys, {"_p5": 5, "p50": 50, "p95": 95}), keys)
    spread = (F.col("p95") - F.col("_p5")) / 2 / F.nullif(F.col("p50"), F.lit(0.0)) * 100
    return out.select(*keys, "least", "p50", "p95", "most", spread.alias("spread_pct"))


def histogram(df: DataFrame, key: Column, name: str) -> DataFrame:
    return df.groupBy(key.alias(name)).agg(F.count("*").alias("n"))


def fixed_bins(value: Column, edges: list[float]) -> Column:
    """Number of the bin [edge i, edge i + 1); -1 below the first edge."""
    out = F.when(value < edges[0], F.lit(-1))
    for i, edge in enumerate(edges[1:]):
        out = out.when(value < edge, F.lit(i))
    return out.when(value.isNotNull(), F.lit(len(edges) - 1))


def share_by(df: DataFrame, source: str, weight: str, keys: list[str]) -> DataFrame:
    """Weight and share of every source in its group, and whether it is the dominant one (ties to the smaller name)."""
    sums = df.groupBy(*keys, source).agg(F.sum(weight).alias("weight"))
    group = Window.partitionBy(*keys)
    first = Window.partitionBy(*keys).orderBy(F.desc("weight"), source)
    return (
        sums.withColumn("share", F.col("weight") / F.nullif(F.sum("weight").over(group), F.lit(0.0)))
        .withColumn("dominant", F.row_number().over(first) == 1)
    )


def mean_of_means(df: DataFrame, value: str, group: str, keys: list[str]) -> DataFrame:
    """Weighted mean of group means with the groups' sizes as weights."""
    each = df.groupBy(*keys, group).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return each.groupBy(*keys).agg((F.sum(F.col("mean") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))).alias("mean"), F.sum("n").alias("n"))


def grouping_report(df: DataFrame, value: str, first: str, second: str) -> DataFrame:
    """Means by each key, both, and over all, in one pass of grouping sets; -1 stands for a key left out."""
    return (
        df.cube(first, second)
        .agg(F.avg(value).alias("mean"), F.count(value).alias("n"), F.grouping_id().alias("level"))
        .select(F.col(first).alias("first"), F.col(second).alias("second"), F.col("level").cast("int").alias("level"), "mean", "n")
    )


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """Ranks over the whole table with ties at their average."""
    ranks = _ranked(df, value, []).select(value, (F.col("upto") - (F.col("c") - 1) / 2.0).alias(name))
    return df.join(ranks, value, "left")


def rank_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman's coefficient of two columns."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return average_ranks(average_ranks(both, x, "_rx"), y, "_ry").agg(F.corr("_rx", "_ry").alias("rho"), F.count("*").alias("n"))


def confusion(df: DataFrame, truth: Column, guess: Column, keys: list[str]) -> DataFrame:
    """True and false positives, false negatives and intersection over union."""
    each = df.select(*keys, truth.alias("t"), guess.alias("g"))
    out = each.groupBy(*keys).agg(
        F.count(F.when(F.col("t") & F.col("g"), 1)).alias("tp"),
        F.count(F.when(~F.col("t") & F.col("g"), 1)).alias("fp"),
        F.count(F.when(F.col("t") & ~F.col("g"), 1)).alias("fn"),
    )
    return out.withColumn("iou", F.col("tp") / F.nullif(F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)))
