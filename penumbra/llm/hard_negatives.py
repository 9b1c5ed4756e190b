"""Exact hard negatives by product quantisation with rigorous bounds.

Vectors are cut into subspaces of two components; a codebook of up to 256 centres a subspace is
fitted on a bounded sample. A row is kept as one code byte a subspace and the norm of what the codes
leave over. For an anchor q the sum of table entries q.c differs from q.v by at most |q| times that
norm, whatever the codebook, so the bounds are rigorous and a poor fit only costs time. Rows whose
bounds can't meet a window, or can't beat what it holds already, are ruled out; the others get their
exact integer inner product.

Rows lie in block files in the folder that the cluster shares. A task holds a block of anchors and
reads the row blocks of its share one after another, so memory doesn't grow with the table, and a
lost task starts again from the same files.
"""

from __future__ import annotations

import io
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penumbra.llm.common import materialise, open_fs, shared_folder, shuffle_partitions

#: Components of a subspace, centres of a codebook, rows that codebooks of one vector length are fitted on (about), steps of the fit.
SUBSPACE, CENTRES, SAMPLE, STEPS = 2, 256, 4096, 6
#: Rows of a block file and anchors of a task on average; block files that a task reads.
BLOCK_ROWS, BLOCK_ANCHORS, SHARE_BLOCKS = 8192, 128, 512
#: Exact products computed at once, and the part by which float bounds give way, far above rounding.
PAIRS, SLACK = 32_768, 1e-9


def _cuts(d: int) -> list[slice]:
    return [slice(i, min(i + SUBSPACE, d)) for i in range(0, d, SUBSPACE)]


def fit_books(vectors: np.ndarray, seed: int = 11) -> list[np.ndarray]:
    """Centres of every subspace by Lloyd's steps; fewer than ``CENTRES`` where the sample has fewer different rows."""
    books, rng = [], np.random.default_rng(seed)
    for cut in _cuts(vectors.shape[1]):
        part = vectors[:, cut].astype(np.float64)
        different = np.unique(part, axis=0)
        centres = different[rng.permutation(len(different))[:CENTRES]]
        for _ in range(STEPS if len(different) > CENTRES else 0):
            near = _nearest(part, centres)
            count = np.bincount(near, minlength=len(centres))
            sums = np.stack([np.bincount(near, part[:, i], len(centres)) for i in range(part.shape[1])], 1)
            centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
        books.append(centres)
    return books


def _nearest(part: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * part @ centres.T).argmin(1)


def encode(vectors: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The codes, a row a subspace, and the norm of each vector's residual, rounded up."""
    codes, left = np.empty((len(books), len(vectors)), np.uint8), np.zeros(len(vectors))
    for j, cut in enumerate(_cuts(vectors.shape[1])):
        part = vectors[:, cut].astype(np.float64)
        codes[j] = _nearest(part, books[j])
        left += ((part - books[j][codes[j]]) ** 2).sum(1)
    return codes, np.sqrt(left) * (1 + SLACK)


class Block:
    """Rows of one file: ids, labels, codes, residual norms, and the exact vectors."""

    def __init__(self, data: dict):
        self.ids, self.rows, self.labels, self.codes, self.left, self.vectors = (data[k] for k in ("ids", "rows", "labels", "codes", "left", "vectors"))
        self.books, self.longest = pickle.loads(data["books"].tobytes()), float(data["longest"])

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible inner product of every anchor with every row."""
        q = anchors.astype(np.float64)
        score = np.zeros((len(q), len(self.ids)))
        for cut, book, codes in zip(_cuts(q.shape[1]), self.books, self.codes, strict=True):
            score += np.take(q[:, cut] @ book.T, codes, axis=1)
        norm = np.sqrt((q**2).sum(1)) * (1 + SLACK)
        gap = norm[:, None] * self.left + (SLACK * (norm * (self.longest + 1) + 1))[:, None]
        return score - gap, score + gap

    def exact(self, anchors: np.ndarray, a: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Integer inner products of the anchors ``a`` with the rows ``n``."""
        out = np.empty(len(a), np.int64)
        for i in range(0, len(a), PAIRS):
            s = slice(i, i + PAIRS)
            out[s] = np.einsum("ij,ij->i", self.vectors[n[s]].astype(np.int64), anchors[a[s]])
        return out


class Best:
    """The ``k`` first rows of each of ``count`` groups: highest scores, ties to smaller ids."""

    def __init__(self, count: int, k: int):
        self.k, self.group, self.score, self.id, self.row = k, *(np.empty(0, np.int64) for _ in range(4))
        self.floor = np.full(count, -np.inf)  # the k-th score of a full group

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        g, s, i, r = (np.concatenate(p) for p in ((self.group, group), (self.score, score), (self.id, ids), (self.row, rows)))
        order = np.lexsort((r, i, -s, g))
        g, s, i, r = g[order], s[order], i[order], r[order]
        place = np.arange(len(g)) - np.searchsorted(g, g)
        kept = place < self.k
        self.group, self.score, self.id, self.row = g[kept], s[kept], i[kept], r[kept]
        last = place[kept] == self.k - 1
        self.floor[self.group[last]] = self.score[last]


def _kth(group: np.ndarray, value: np.ndarray, count: int, k: int) -> np.ndarray:
    """The k-th largest value of each group, minus infinity for groups of fewer."""
    out = np.full(count, -np.inf)
    order = np.lexsort((-value, group))
    g, v = group[order], value[order]
    place = np.arange(len(g)) - np.searchsorted(g, g)
    out[g[place == k - 1]] = v[place == k - 1]
    return out


def add_positives(best: Best, block: Block, anchors: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> None:
    """Offer a block's rows of the anchors' own labels."""
    low, high = block.bounds(anchors)
    a, n = np.nonzero((labels[:, None] == block.labels) & (rows[:, None] != block.rows) & (high >= best.floor[:, None]))
    floor = np.maximum(best.floor, _kth(a, low[a, n], len(anchors), best.k))
    kept = high[a, n] >= floor[a]
    a, n = a[kept], n[kept]
    best.add(a, block.exact(anchors, a, n), block.ids[n], block.rows[n])


def add_negatives(best: Best, block: Block, anchors: np.ndarray, labels: np.ndarray, of: np.ndarray, score: np.ndarray, low: int, high: int) -> None:
    """Offer a block's rows of other labels to the windows. Window w belongs to anchor ``of[w]``, ascending, and
    spans ``low`` to ``high`` percent of ``score[w]``."""
    if not len(of):
        return
    least, most = block.bounds(anchors)
    bottom, top = low * score / 100, high * score / 100
    need = np.maximum(bottom, best.floor)
    first, windows = np.searchsorted(of, np.arange(len(anchors))), np.bincount(of, minlength=len(anchors))
    widest = np.full((2, len(anchors)), np.inf)
    np.minimum.at(widest[0], of, need)
    np.minimum.at(widest[1], of, -top)
    a, n = np.nonzero((labels[:, None] != block.labels) & (most >= widest[0][:, None]) & (least <= -widest[1][:, None]))
    for i in range(int(windows.max())):  # the i-th window of every anchor
        has = windows[a] > i
        b, m = a[has], n[has]
        w, lo, hi = first[b] + i, least[b, m], most[b, m]
        sure = (hi <= top[w]) & (lo >= bottom[w])
        floor = np.maximum(need, _kth(w[sure], lo[sure], len(of), best.k))
        kept = (hi >= floor[w]) & (lo <= top[w])
        b, m, w = b[kept], m[kept], w[kept]
        exact = block.exact(anchors, b, m)
        inside = (100 * exact >= low * score[w]) & (100 * exact <= high * score[w])
        best.add(w[inside], exact[inside], block.ids[m[inside]], block.rows[m[inside]])


def _matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.int64())
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def _fit(table: pa.Table) -> pa.Table:
    table = table.sort_by("row")
    d = table.column("d")[0].as_py()
    return pa.table({"d": table.column("d")[:1], "books": pa.array([pickle.dumps(fit_books(_matrix(table.column("v"), d)))], pa.binary())})


def _write_block(folder: str):
    def run(rows: pa.Table, books: pa.Table) -> pa.Table:
        schema = pa.schema([("d", pa.int32()), ("block", pa.int32()), ("file", pa.string())])
        if not rows.num_rows:
            return schema.empty_table()
        d, block = rows.column("d")[0].as_py(), rows.column("block")[0].as_py()
        rows = rows.sort_by("row")
        vectors = _matrix(rows.column("v"), d)
        # A length whose sample came out empty has one centre at 0: bounds are then those of the lengths alone.
        packed = books.column("books")[0].as_py() if books.num_rows else pickle.dumps([np.zeros((1, c.stop - c.start)) for c in _cuts(d)])
        codes, left = encode(vectors, pickle.loads(packed))
        out = io.BytesIO()
        numbers = {k: rows.column(c).to_numpy() for k, c in (("ids", "vec_id"), ("rows", "row"), ("labels", "label"))}
        small = np.min_scalar_type(-int(np.abs(vectors).max(initial=0)) - 1)
        longest = np.sqrt((vectors.astype(np.float64) ** 2).sum(1)).max()
        np.savez(out, **numbers, codes=codes, left=left, vectors=vectors.astype(small), books=np.frombuffer(packed, np.uint8), longest=longest)
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        name, attempt = f"rows-{d}-{block:07d}.npz", TaskContext.get().taskAttemptId()
        with fs.open_output_stream(f"{root}/.{name}-{attempt}") as f:
            f.write(out.getvalue())
        fs.move(f"{root}/.{name}-{attempt}", f"{root}/{name}")  # whole or not at all, and the same bytes whichever attempt is last
        return pa.table([pa.array([d], pa.int32()), pa.array([block], pa.int32()), pa.array([name])], schema=schema)

    return run


def _pack_anchors(table: pa.Table) -> pa.Table:
    table = table.sort_by("row")
    d = table.column("d")[0].as_py()
    wins = table.column("positives").to_pylist()
    packed = pickle.dumps((*(table.column(c).to_numpy() for c in ("vec_id", "row", "label")), _matrix(table.column("v"), d), wins))
    return pa.table({"d": table.column("d")[:1], "part": table.column("part")[:1], "anchors": pa.array([packed], pa.binary())})


def _mine(folder: str, positives: int, negatives: int, low: int, high: int):
    """Runs over rows ``anchors, files``: the nearest rows of the anchors' labels (``negatives`` 0), or those in their windows."""
    names = ["anchor_row", "anchor_id", "positive_row", "positive_id", "positive_score", "row", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        for batch in batches:
            for packed, files in zip(batch.column("anchors"), batch.column("files"), strict=True):
                ids, rows, labels, vectors, wins = pickle.loads(packed.as_py())
                if negatives:
                    flat = [(a, p["row"], p["vec_id"], p["score"]) for a, ps in enumerate(wins) for p in ps if low * p["score"] <= high * p["score"]]
                    of, p_row, p_id, p_score = (np.array(c, np.int64) for c in (zip(*flat, strict=True) if flat else [[]] * 4))
                    best = Best(len(of), negatives)
                else:
                    of, best = np.arange(len(ids)), Best(len(ids), positives)
                for file in files.as_py():
                    with fs.open_input_file(f"{root}/{file}") as f, np.load(io.BytesIO(f.read())) as data:
                        block = Block(dict(data))
                    if negatives:
                        add_negatives(best, block, vectors, labels, of, p_score, low, high)
                    else:
                        add_positives(best, block, vectors, labels, rows)
                own = of[best.group]
                window = [c[best.group] for c in (p_row, p_id, p_score)] if negatives else [best.row, best.id, best.score]
                columns = [rows[own], ids[own], *window, best.row, best.id, best.score]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return run


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column | None = None,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_rows: int = BLOCK_ROWS,
    block_anchors: int = BLOCK_ANCHORS,
    share_blocks: int = SHARE_BLOCKS,
) -> DataFrame:
    """Rows of other labels that score between ``low`` and ``high`` percent of a positive's score, the first ``negatives`` of them.

    ``is_anchor`` is a condition on ``vec_id``, ``label`` an expression over the input's columns (the
    column ``label``). Components become floor(``scale`` * x) of the double x; a score is the integer inner
    product with the anchor; higher scores come first, ties to smaller ids. An anchor's positives are its
    first ``positives`` other rows of its label. Returns ``anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score`` and ``positive_rank``.

    Null ids, null labels, empty vectors and vectors that are null or hold null or non-finite components take
    no part; vectors meet those of their own length. Rows that repeat an id are rows of their own, as anchors too.
    An anchor without positives, and a window without rows, gives no row; neither does a negative positive score,
    whose window is empty. An empty table gives an empty table. Vectors whose inner products might pass 2**56 end
    the job with an error that says so.

    Codebooks are fitted on about ``SAMPLE`` rows a vector length, chosen by a hash; the results don't depend on them.
    """
    spark = vectors.sparkSession
    x, spoilt = F.col("x"), lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    scaled = F.transform(x, lambda c: F.when(F.abs(c * scale) < 2.0**56, F.floor(c * scale)).otherwise(F.raise_error(F.lit("a component is too large for an inner product in a long"))).cast("long"))
    rows = (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
        .where("vec_id is not null and label is not null and x is not null and size(x) > 0")
        .where(~F.exists("x", spoilt))
        .select("vec_id", "label", scaled.alias("v"), F.size("x").alias("d"), F.monotonically_increasing_id().alias("row"))
    )
    rows = materialise(rows, "vectors")
    many = lambda n, size: F.greatest(F.lit(1), F.ceil(n / F.lit(size))).cast("int")
    widest = F.max(F.array_max(F.transform("v", F.abs))).cast("double")
    sizes = rows.groupBy("d").agg(
        F.count("*").alias("n"),
        many(F.count("*"), block_rows).alias("blocks"),
        many(F.sum(F.when(is_anchor, 1).otherwise(0)), block_anchors).alias("parts"),
        F.when(widest * widest * F.col("d") < 2.0**56, F.lit(True)).otherwise(F.raise_error(F.lit("inner products might not fit a long")).cast("boolean")).alias("fits"),
    )
    sizes = materialise(sizes, "sizes")  # a row a vector length
    rows = rows.join(sizes.where("fits").drop("fits"), "d")
    dealt = lambda salt, n: F.pmod(F.xxhash64("row", F.lit(salt)), F.col(n)).cast("int")
    sample = rows.where(F.pmod(F.xxhash64("row", F.lit(3)), F.lit(1 << 30)) < SAMPLE / F.col("n") * (1 << 30))
    books = materialise(sample.select("d", "row", "v").groupBy("d").applyInArrow(_fit, "d int, books binary"), "books")
    folder = shared_folder(spark, "hard-negatives")
    each = books.join(sizes, "d").select("d", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "books")
    blocks = rows.select("d", dealt(0, "blocks").alias("block"), "vec_id", "row", "label", "v").groupBy("d", "block").cogroup(each.groupBy("d", "block"))
    files = materialise(blocks.applyInArrow(_write_block(folder), "d int, block int, file string"), "files")
    shares = files.groupBy("d", F.floor(F.col("block") / share_blocks).alias("share")).agg(F.sort_array(F.collect_list("file")).alias("files"))
    shares = materialise(shares, "shares")
    anchors = materialise(rows.where(is_anchor).select("d", dealt(1, "parts").alias("part"), "vec_id", "row", "label", "v"), "anchors")

    def mined(asked: DataFrame, found: int) -> DataFrame:
        packed = asked.groupBy("d", "part").applyInArrow(_pack_anchors, "d int, part int, anchors binary")
        # Every block of anchors meets every share of the rows: a stated query set against all rows, in blocks.
        tasks = materialise(packed, "asked").join(shares, "d").repartition(shuffle_partitions(spark), "d", "part", "share")
        schema = ", ".join(f"{c} long" for c in ("anchor_row", "anchor_id", "positive_row", "positive_id", "positive_score", "row", "vec_id", "score"))
        return tasks.select("anchors", "files").mapInArrow(_mine(folder, positives, found, low, high), schema)

    no_windows = F.array().cast("array<struct<place:int,row:bigint,vec_id:bigint,score:bigint>>")
    order = Window.partitionBy("anchor_row").orderBy(F.desc("score"), "vec_id", "row")
    near = mined(anchors.withColumn("positives", no_windows), 0).withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    near = materialise(near.select("anchor_row", "place", "row", "vec_id", "score"), "positives")
    windows = near.groupBy(F.col("anchor_row").alias("row")).agg(F.sort_array(F.collect_list(F.struct("place", "row", "vec_id", "score"))).alias("positives"))
    found = mined(anchors.join(windows, "row"), negatives)
    order = Window.partitionBy("anchor_row", "positive_row").orderBy(F.desc("score"), "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    ranked = ranked.join(near.select("anchor_row", F.col("row").alias("positive_row"), F.col("place").alias("positive_rank")), ["anchor_row", "positive_row"])
    return ranked.select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"), "positive_rank"
    )
