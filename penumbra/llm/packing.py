"""Packing documents into fixed token windows by best-two-fit.

A bin takes the largest unpacked piece that fits until none does; then its smallest piece gives
way to the two unpacked pieces that together fill the widened gap best, if they fill more than it
did. Pieces are dealt into packing groups of bounded size by a hash, so the waste at a group's end
stays a small constant share at any number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penumbra.llm.common import slices, text_or_empty
from penumbra.llm.tokens import file_encoder

#: Short pieces that a packing group holds on average.
GROUP_PIECES = 4096
#: Bytes of text that a task encodes at once; arrays over all their places and pieces are held beside them.
SLICE = 1 << 20
COLUMNS = ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]


class Lengths:
    """Unpacked pieces by length, with a bit set of the lengths that occur."""

    def __init__(self, lengths: list[int]):
        self.rows: dict[int, list[int]] = {}
        for row in reversed(range(len(lengths))):
            self.rows.setdefault(lengths[row], []).append(row)
        self.bits = sum(1 << n for n in self.rows)

    def largest(self, limit: int) -> int:
        """The largest length up to ``limit`` that occurs; 0 if none does."""
        return max(0, (self.bits & ((1 << (limit + 1)) - 1)).bit_length() - 1) if limit > 0 else 0

    def take(self, n: int) -> int:
        row = self.rows[n].pop()
        if not self.rows[n]:
            del self.rows[n]
            self.bits &= ~(1 << n)
        return row

    def put(self, n: int, row: int) -> None:
        self.rows.setdefault(n, []).append(row)
        self.bits |= 1 << n

    def best_two(self, gap: int, least: int) -> tuple[int, int]:
        """Lengths a >= b of two pieces with the largest sum over ``least`` and up to ``gap``; zeros if none."""
        best, found = least, (0, 0)
        a = self.largest(gap - 1)
        while a and 2 * a > best:
            b = self.largest(min(a, gap - a))
            if b == a and len(self.rows[a]) < 2:
                b = self.largest(a - 1)
            if b and a + b > best:
                best, found = a + b, (a, b)
                if best == gap:
                    break
            a = self.largest(a - 1)
        return found


def best_two_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of row numbers; every length lies in 1..capacity."""
    left, bins = Lengths(lengths), []
    while left.bits:
        gap, taken = capacity, []
        while n := left.largest(gap):
            taken.append((n, left.take(n)))
            gap -= n
        if gap and (pair := left.best_two(gap + taken[-1][0], taken[-1][0]))[0]:
            smallest = taken.pop()
            taken += [(n, left.take(n)) for n in pair]
            left.put(*smallest)
        bins.append([row for _, row in taken])
    return bins


def _cut(path: str, end_id: int, window: int, dtype: str):
    names, types = ["doc_id", "piece", "start", "length", "ids"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = file_encoder(path), np.array([end_id], np.uint32)
        for batch in batches:
            for part in slices(batch, size=SLICE):
                rows = []
                for doc_id, raw in zip(part.column("doc_id").to_pylist(), encode(part.column("text")), strict=True):
                    ids = np.append(np.frombuffer(raw.as_buffer(), np.uint32), end).astype(dtype)
                    n = len(ids)
                    at, piece, size = 0, 0, n % window or window
                    while at < n:
                        rows.append((doc_id, piece, at, size, ids[at : at + size].tobytes()))
                        at, piece, size = at + size, piece + 1, window
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


def _pack(window: int, dtype: str):
    def run(table: pa.Table) -> pa.Table:
        # A stable order first, so that a task that runs again packs alike.
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("length", "ascending")])
        sequence, offset = np.zeros(table.num_rows, np.int64), np.zeros(table.num_rows, np.int64)
        lengths = table.column("length").to_pylist()
        first = table.column("packing_group")[0].as_py() << 32
        for number, rows in enumerate(best_two_fit(lengths, window)):
            at = 0
            for row in rows:
                sequence[row], offset[row] = first + number, at
                at += lengths[row]
        ids = pa.array([np.frombuffer(x, dtype).astype("<u4").tobytes() for x in table.column("ids").to_pylist()], pa.binary())
        table = table.drop_columns(["packing_group", "ids"]).append_column("ids", ids)
        return table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).select(COLUMNS)

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 0,
    window: int = 2048,
    vocabulary: int = 50257,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """Every document's ids (with the end id) as pieces of at most ``window`` ids, each with its place.

    Returns ``doc_id``, ``piece``, ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit),
    ``sequence_id`` and ``offset``. Only longer documents are cut; their first piece holds the
    remainder. Null text counts as empty (the end id alone); null ids and repeated rows are packed
    like any other; other columns are ignored; an empty table gives an empty table. Pieces travel
    as two-byte ids where the vocabulary allows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    groups = max(1, -(-docs.count() // group_pieces))
    dtype = "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"
    cut = rows.mapInArrow(_cut(tokenizer_path, end_id, window, dtype), "doc_id long, piece int, start long, length long, ids binary")
    # Every document has one piece that may be short; those share the groups, dealt by a hash (with the row number, so
    # repeated rows of an id spread too). A full piece is a sequence by itself: a run of them of bounded length is a group.
    number = F.monotonically_increasing_id()
    short = F.pmod(F.xxhash64("doc_id", "piece", number), F.lit(groups))
    full = -1 - F.shiftright(number, 11)
    dealt = cut.withColumn("packing_group", F.when(F.col("length") < window, short).otherwise(full))
    return dealt.groupBy("packing_group").applyInArrow(
        _pack(window, dtype), "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"
    )
