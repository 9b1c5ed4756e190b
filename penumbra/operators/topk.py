"""Top-k, skyline and nearest-neighbour selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def best_per_group(df: DataFrame, group: str, order: list[Column | str], count: int) -> DataFrame:
    """The best row of every group, of these the ``count`` best; the order must end in a unique column."""
    first = df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("_n = 1").drop("_n")
    return first.orderBy(*order).limit(count)


def skyline(df: DataFrame, id_col: str, low: str, high: str) -> DataFrame:
    """Rows that no other row beats: smaller or equal ``low`` and greater or equal ``high``, one of them strictly.

    Of the rows of one ``low`` only those with its greatest ``high`` can stay, and they stay if it
    exceeds the greatest ``high`` of all smaller ``low``. The running maximum is taken inside
    ranges of ``low`` and carried across them, so no task holds all rows.
    """
    known = df.where(F.col(low).isNotNull() & F.col(high).isNotNull())
    steps = known.groupBy(low).agg(F.max(high).alias("_top"))
    limits = sorted(set(known.approxQuantile(low, [i / 64 for i in range(1, 64)], 0.005)))
    bounds = F.array(*map(F.lit, limits)) if limits else F.array().cast("array<double>")
    steps = steps.withColumn("_range", F.size(F.filter(bounds, lambda b: b <= F.col(low))))
    inside = Window.partitionBy("_range").orderBy(low).rowsBetween(Window.unboundedPreceding, -1)
    tops = steps.groupBy("_range").agg(F.max("_top").alias("_m"))
    below = tops.select("_range", F.max("_m").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_below"))
    front = (
        steps.withColumn("_inside", F.max("_top").over(inside))
        .join(below, "_range")
        .where(F.coalesce(F.col("_top") > F.greatest("_inside", "_below"), F.lit(True)))
        .select(low, "_top")
    )
    return known.join(front, low).where(F.col(high) == F.col("_top")).drop("_top")


def knee(front: DataFrame, id_col: str, low: str, high: str) -> DataFrame:
    """The row of a front nearest to its ideal corner after min-max scaling; an empty range counts as 1, ties go to the smaller id."""
    ranges = front.agg(F.min(low).alias("_a"), F.max(low).alias("_b"), F.min(high).alias("_c"), F.max(high).alias("_d"))  # one row
    one = lambda lo, hi: F.when(F.col(hi) == F.col(lo), F.lit(1.0)).otherwise(F.col(hi) - F.col(lo))
    away = F.sqrt(F.pow((F.col(low) - F.col("_a")) / one("_a", "_b"), F.lit(2)) + F.pow((F.col("_d") - F.col(high)) / one("_c", "_d"), F.lit(2)))
    scored = front.join(F.broadcast(ranges), F.lit(True)).withColumn("ideal_distance", away).drop("_a", "_b", "_c", "_d")
    return scored.orderBy("ideal_distance", id_col).limit(1)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)


#: Candidates and queries of a block; a task holds one block of each.
BLOCK, QUERY_BLOCK = 32768, 16384
#: Distances that a task works out at a time.
_TILE = 1 << 22


def _matrix(rows, width: int):
    """A list column of Arrow as a matrix of doubles; vectors that are null, of another length or hold a null become NaN."""
    import numpy as np

    rows = rows.combine_chunks() if hasattr(rows, "combine_chunks") else rows
    if not rows.null_count and len(rows):
        flat = rows.flatten()
        if not flat.null_count and len(flat) == width * len(rows) and (np.diff(rows.offsets.to_numpy()) == width).all():
            return flat.to_numpy(zero_copy_only=False).reshape(-1, width)
    made = np.full((len(rows), width), np.nan)
    for i, v in enumerate(rows.to_pylist()):
        if v is not None and len(v) == width and None not in v:
            made[i] = v
    return made


def _nearest_of_block(q_ids, q, ids, v, k: int):
    """``(query_id, id, distance)`` arrays: the ``k`` nearest of a block, ties to the smaller id, a distance that is no number last.

    A product of matrices gives distances up to a rigorous rounding error; what that can't rule out gets its distance summed in the
    order of the components, so distances and ties are those of ``squared_distance``.
    """
    import numpy as np

    width = q.shape[1]
    with np.errstate(all="ignore"):
        qq, vv = (q * q).sum(1), (v * v).sum(1)
        known = vv[np.isfinite(vv)]
        error = (width + 16) * 8 * np.finfo(float).eps * (qq + (known.max() if len(known) else 0.0)) + 1e-300
        out, rows = [], max(1, _TILE // max(len(ids), 1))
        for at in range(0, len(q_ids), rows):
            part = slice(at, at + rows)
            near = qq[part, None] + vv[None, :] - 2.0 * (q[part] @ v.T)
            near[q_ids[part, None] == ids[None, :]] = np.inf
            taken = min(k, len(ids)) - 1
            limit = np.partition(near, taken, axis=1)[:, taken] + 2 * error[part]
            # Where fewer than k distances are finite, all candidates stay.
            a, b = np.nonzero((near <= limit[:, None]) | ~np.isfinite(limit)[:, None])
            a = a + at
            other = q_ids[a] != ids[b]
            a, b = a[other], b[other]
            away = np.zeros(len(a))
            for j in range(width):
                d = q[a, j] - v[b, j]
                away += d * d
            order = np.lexsort((ids[b], away, q_ids[a]))
            a, b, away = a[order], b[order], away[order]
            first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else a
            place = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)]))
            out.append((q_ids[a[place < k]], ids[b[place < k]], away[place < k]))
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def nearest_vectors(queries: DataFrame, candidates: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """The ``k`` nearest candidates ``id, v`` of each query ``query_id, q``, ties to the smaller id; a query never finds itself.

    All queries meet all candidates, which grows with the square of the table where the queries do: both are dealt to blocks by
    a hash, and each pair of blocks is one group of a grouped map, which hands on only its own best. Vectors that are
    null, hold a null or are of another length than the rest have no distance (null) and are the farthest of all.
    """
    width = candidates.where("v is not null").select(F.size("v").alias("n")).groupBy("n").count().orderBy(F.desc("count"), "n").first()
    width = width["n"] if width else 0
    blocks, query_blocks = max(-(-candidates.count() // block), 1), max(-(-queries.count() // QUERY_BLOCK), 1)
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = candidates.select("id", "v", deal("id", blocks).alias("_c"), all_of(query_blocks).alias("_q"))
    sent = queries.select(F.col("query_id"), "q", deal("query_id", query_blocks).alias("_q"), all_of(blocks).alias("_c"))
    types = {c: (queries if c == "query_id" else candidates).schema[c].dataType for c in ("query_id", "id")}

    def best(left, right):
        import numpy as np
        import pyarrow as pa

        # Rows without an id are matched by nothing.
        left, right = left.filter(left["query_id"].is_valid()), right.filter(right["id"].is_valid())
        q_ids, ids = left["query_id"].to_numpy(), right["id"].to_numpy()
        if not len(q_ids) or not len(ids):
            found = (q_ids[:0], ids[:0], np.zeros(0))
        else:
            found = _nearest_of_block(q_ids, _matrix(left["q"], width), ids, _matrix(right["v"], width), k)
        away = pa.array(found[2], mask=np.isnan(found[2]))
        return pa.table({"query_id": pa.array(found[0], left["query_id"].type), "id": pa.array(found[1], right["id"].type), "distance": away})

    schema = T.StructType([T.StructField("query_id", types["query_id"]), T.StructField("id", types["id"]), T.StructField("distance", T.DoubleType())])
    pairs = sent.groupBy("_c", "_q").cogroup(dealt.groupBy("_c", "_q")).applyInArrow(best, schema)
    w = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), "id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def two_stage(queries: DataFrame, candidates: DataFrame, scale: float, shortlist: int, k: int) -> DataFrame:
    """The ``k`` nearest of a ``shortlist`` by vectors quantised to whole steps of ``scale``, ranked again exactly."""
    quantise = lambda v: F.transform(v, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.floor(x / scale + 0.5))))
    short = nearest_vectors(
        queries.select("query_id", quantise("q").alias("q")), candidates.select("id", quantise("v").alias("v")), shortlist
    ).select("query_id", "id")
    exact = short.join(queries, "query_id").join(candidates, "id").withColumn("distance", squared_distance(F.col("q"), F.col("v")))
    w = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), "id")
    return exact.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of each query's true partners that were found."""
    hit = truth.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def nearest_centre(df: DataFrame, vector: Column, centres: list[list[float]]) -> DataFrame:
    """Number of the first nearest of some fixed centres, as ``type_id``."""
    gaps = F.array(*[squared_distance(vector, F.array(*map(F.lit, c))) for c in centres])
    return df.withColumn("type_id", (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int"))


def project(vector: Column, mean: list[float], components: list[list[float]], scales: list[float]) -> Column:
    """Signature of a vector: centred, projected, quantised to -127 to 127 with halves up."""
    centred = F.zip_with(vector, F.array(*map(F.lit, mean)), lambda x, m: x - m)
    dots = [F.aggregate(F.zip_with(centred, F.array(*map(F.lit, c)), lambda x, y: x * y), F.lit(0.0), lambda s, d: s + d) for c in components]
    return F.array(*[F.greatest(F.lit(-127), F.least(F.lit(127), F.floor(d / s + 0.5))).cast("int") for d, s in zip(dots, scales, strict=True)])
