"""Exact top-k by inner product with M-trees and best-first search.

With M the largest squared length, the vector x extended by sqrt(M - |x|^2) has length sqrt(M) for
every x, so for a query extended by 0 the squared distance is |q|^2 + M - 2 q.x: the order of
distances is the order of inner products backwards, and a metric tree answers the search. Vectors
are dealt into trees of bounded size by a hash. A tree is pages of entries; an entry of an inner
page has a routing object, the covering radius of its page and the distance to the object of the
page above. Best-first search takes the page whose lower bound is least; from the stored distances
the triangle inequality rules entries out before their own distance is computed.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penumbra.llm.common import materialise, shuffle_partitions

#: Entries of a page, vectors of a tree on average, and queries of a block.
PAGE, TREE_VECTORS, BLOCK_QUERIES = 64, 8192, 512
#: Factor by which bounds give way, far above the rounding of double arithmetic; and where doubles don't hold the products exactly,
#: above the square root of that rounding, as a distance is the root of a difference.
SLACK, WIDE_SLACK = 1e-9, 1e-6
#: Products below this are exact in doubles; those that may reach the second don't fit a long.
EXACT, MOST = 1 << 53, 1 << 62


class MTree:
    """A bulk-loaded M-tree over integer vectors. Where double arithmetic doesn't hold their products exactly, the whole vectors
    are kept beside for the scores, and the bounds give way more."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float, rows: np.ndarray | None = None):
        self.ids, self.vectors = ids, vectors.astype(np.float64)
        self.whole = vectors.astype(np.int64) if longest >= EXACT // 4 else None
        self.rows = np.arange(len(ids)) if rows is None else rows
        square = (vectors.astype(np.int64) ** 2).sum(1)
        self.extra = np.sqrt(np.maximum(int(longest) - square, 0).astype(np.float64))
        self.longest = longest
        #: A page: objects, their distances to the page's own object, radii (0 in a leaf), pages below (-1 in a leaf).
        self.pages: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.root = self._load(np.arange(len(ids)), None)

    def _distances(self, rows: np.ndarray, to: int) -> np.ndarray:
        # Differences, not lengths, so that equal vectors are at distance 0 exactly.
        gap = self.vectors[rows] - self.vectors[to]
        return np.sqrt((gap**2).sum(1) + (self.extra[rows] - self.extra[to]) ** 2)

    def _load(self, rows: np.ndarray, parent: int | None) -> int:
        def page(objects, radii, below):
            at = self._distances(objects, parent) if parent is not None else np.zeros(len(objects))
            self.pages.append((objects, at, np.asarray(radii, np.float64), np.asarray(below, np.int64)))
            return len(self.pages) - 1

        if len(rows) <= PAGE:
            return page(rows, np.zeros(len(rows)), np.full(len(rows), -1))
        # Routing objects: each in turn the vector farthest from those taken.
        count = min(PAGE, -(-len(rows) // PAGE) + 1)
        taken, near, owner = [int(rows[0])], self._distances(rows, int(rows[0])), np.zeros(len(rows), np.int64)
        while len(taken) < count and near.max() > 0:
            taken.append(int(rows[int(near.argmax())]))
            d = self._distances(rows, taken[-1])
            owner[d < near] = len(taken) - 1
            near = np.minimum(near, d)
        if len(taken) == 1:  # equal vectors: any cut will do
            groups = [(int(g[0]), g) for g in np.array_split(rows, min(PAGE, -(-len(rows) // PAGE)))]
        else:
            groups = [(t, rows[owner == i]) for i, t in enumerate(taken)]
        objects = np.array([t for t, _ in groups])
        radii = [float(self._distances(g, t).max()) for t, g in groups]
        return page(objects, radii, [self._load(g, t) for t, g in groups])

    def search(self, query: np.ndarray, k: int, own: int | None, floor: int | None = None) -> list[tuple[int, int]]:
        """``(score, id)`` of the k highest inner products, ties to smaller ids, without the row ``own``; with
        ``floor`` those below it may be left out."""
        q = query.astype(np.float64)
        base = float(q @ q) + self.longest
        slack = (SLACK if self.whole is None else WIDE_SLACK) * np.sqrt(base)
        best: list[tuple[float, int]] = []  # a heap of (score, -id), the worst first
        limit = beyond = np.inf if floor is None else float(np.sqrt(max(base - 2 * floor, 0)))  # the distance of the k-th
        queue = [(0.0, self.root, -1.0)]
        while queue:
            bound, page, above = heapq.heappop(queue)
            if bound > limit + slack:
                break
            objects, at, radii, below = self.pages[page]
            keep = np.arange(len(objects))
            if above >= 0 and limit < np.inf:
                keep = np.flatnonzero(np.abs(above - at) - radii <= limit + slack)
            if not len(keep):
                continue
            objects = objects[keep]
            scores = self.vectors[objects] @ q
            distances = np.sqrt(np.maximum(base - 2 * scores, 0))
            if below[0] >= 0:
                for d, r, child in zip(distances.tolist(), radii[keep].tolist(), below[keep].tolist(), strict=True):
                    if (low := max(d - r, 0.0)) <= limit + slack:
                        heapq.heappush(queue, (low, child, d))
                continue
            for i in np.flatnonzero(distances <= limit + slack).tolist():
                if self.rows[objects[i]] == own:
                    continue
                score = scores[i] if self.whole is None else int(self.whole[objects[i]] @ query)
                item = (score, -int(self.ids[objects[i]]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
                if len(best) == k:
                    limit = min(beyond, float(np.sqrt(max(base - 2 * best[0][0], 0))))
        return [(int(s), -i) for s, i in best]


def _vectors(table: pa.Table) -> np.ndarray:
    return np.array(table.column("v").to_pylist(), np.int64)


def _tree(table: pa.Table) -> pa.Table:
    table = table.sort_by([("vec_id", "ascending"), ("row", "ascending")])
    tree = MTree(np.array(table.column("vec_id")), _vectors(table), table.column("longest")[0].as_py(), np.array(table.column("row")))
    return pa.table({"d": table.column("d")[:1], "tree": table.column("tree")[:1], "pages": pa.array([pickle.dumps(tree)], pa.binary())})


def _block(table: pa.Table) -> pa.Table:
    table = table.sort_by([("vec_id", "ascending"), ("row", "ascending")])
    packed = pickle.dumps((table.column("vec_id").to_pylist(), table.column("row").to_pylist(), table.column("floor").to_pylist(), _vectors(table)))
    return pa.table({"d": table.column("d")[:1], "part": table.column("part")[:1], "queries": pa.array([packed], pa.binary())})


def _search(k: int):
    names = ["query_id", "query_row", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pages, queries in zip(batch.column("pages"), batch.column("queries"), strict=True):
                tree, (ids, rows, floors, vectors) = pickle.loads(pages.as_py()), pickle.loads(queries.as_py())
                found = [
                    (q, row, i, s) for q, row, floor, v in zip(ids, rows, floors, vectors, strict=True) for s, i in tree.search(v, k, row, floor)
                ]
                columns = list(zip(*found, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 1024) -> DataFrame:
    """``vec_id`` and ``v``: every component as floor(scale * x) of the double x. Vectors that are null or
    hold null or non-finite components, null ids and empty vectors take no part. A component too large for a product in a long ends the job
    with an error that says so."""
    x = F.col(vector_col).cast("array<double>")
    whole = lambda c: F.when(F.abs(c * scale) < float(MOST), F.floor(c * scale)).otherwise(F.raise_error(F.lit("a component is too large for an inner product in a long"))).cast("long")
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
        .where("vec_id is not null and x is not null and size(x) > 0")
        .where(~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
        .select("vec_id", F.transform("x", whole).alias("v"))
    )


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    tree_vectors: int = TREE_VECTORS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """The ``k`` highest integer inner products of every query row with all other rows.

    ``is_query`` is a condition on ``vec_id``. Returns ``query_id``, ``rank`` (from 1), ``vec_id``
    and ``score``; ties go to smaller ids; a query with fewer partners gets them all. Rows that repeat
    an id are candidates, and queries, each of its own. Vectors meet only vectors of their own
    length, as others have no product with them. Other columns are ignored; an empty table gives an
    empty table. Products are exact up to 2**62; vectors of a greater squared length end the job with an error that says so.

    Every query block first searches one tree; what it finds there bounds the search of all others.
    """
    clean = materialise(usable(vectors, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()), "vectors")
    about = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    sum_ = F.aggregate("v", F.lit(0).cast("long"), lambda s, c: s + c * c)
    square = F.when(about < float(MOST), sum_).otherwise(F.raise_error(F.lit("a vector is too long for an inner product in a long")).cast("long"))
    many = lambda rows, size: F.greatest(F.lit(1), F.ceil(rows / F.lit(size))).cast("int")
    sizes = clean.groupBy(F.size("v").alias("d")).agg(
        many(F.count("*"), tree_vectors).alias("trees"), many(F.sum(F.when(is_query, 1).otherwise(0)), block_queries).alias("blocks"), F.max(square).alias("longest")
    )
    sizes = materialise(sizes, "sizes")  # a row a vector length
    clean = clean.withColumn("d", F.size("v")).join(sizes, "d")
    dealt = lambda salt, n: F.pmod(F.xxhash64("row", F.lit(salt)), F.col(n)).cast("int")
    built = clean.withColumn("tree", dealt(0, "trees")).groupBy("d", "tree").applyInArrow(_tree, "d int, tree int, pages binary")
    built = materialise(built, "trees").join(sizes.drop("longest"), "d")
    asked = materialise(clean.where(is_query).withColumn("part", dealt(1, "blocks")).select("d", "part", "vec_id", "row", "v"), "queries")

    def met(queries: DataFrame, pairs: DataFrame) -> DataFrame:
        blocks = queries.groupBy("d", "part").applyInArrow(_block, "d int, part int, queries binary")
        spread = pairs.join(materialise(blocks, "blocks"), ["d", "part"]).repartition(shuffle_partitions(vectors.sparkSession), "d", "tree", "part")
        return spread.select("pages", "queries").mapInArrow(_search(k), "query_id long, query_row long, vec_id long, score long")

    # Every query block meets every tree once: a stated query set against all rows, in blocks.
    pairs = built.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    near = F.pmod(F.col("part"), F.col("trees")) == F.col("tree")
    first = materialise(met(asked.withColumn("floor", F.lit(None).cast("long")), pairs.where(near)), "first")
    floors = first.groupBy(F.col("query_row").alias("row")).agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    found = first.union(met(asked.join(floors, "row", "left"), pairs.where(~near)))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
