"""Byte-level BPE with a hierarchical-bitmap rank queue, and its decoder.

Each merge rank has a bucket of linked-list positions, and a two-level bitmap tells which buckets
hold any. Find-first-set gives the next rank; the leftmost position of its bucket is merged unless
the entry is stale. A pre-token of n bytes costs O(n log n) at any length, because a merge only
looks at its two neighbours.
"""

from __future__ import annotations

import base64
import gc
from array import array
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penumbra.llm.common import open_fs, slices, text_or_empty
from penumbra.llm.tokens import ONE_WORD, PieceEncoder

#: Neighbour pairs that a worker remembers between pre-tokens.
CACHE_PAIRS = 500_000
#: Ranks under one bit of the upper bitmap: 1 << SHIFT.
SHIFT, MASK = 10, 1023
_BIT = [1 << i for i in range(1 << SHIFT)]


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file: a base64 token and its rank a line."""
    fs, inside = open_fs(path if ":/" in path else f"file://{path}")
    with fs.open_input_stream(inside) as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f.read().splitlines()) if token}


def _put(buckets: dict, rank: int, i: int) -> None:
    """One more position in a filled bucket."""
    bucket = buckets[rank]
    if type(bucket) is list:
        heappush(bucket, i)
    else:
        buckets[rank] = [bucket, i] if bucket < i else [i, bucket]


def _take(buckets: dict, rank: int) -> int:
    """The leftmost position of a bucket of several."""
    bucket = buckets[rank]
    i = heappop(bucket)
    if len(bucket) == 1:
        buckets[rank] = bucket[0]
    return i


class BytePairEncoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token
        self.words = pa.array(self.table, pa.large_binary())
        self.single = [ranks[bytes([b])] for b in range(256)]
        #: Ranks of two bytes side by side, by the first; -1 if they don't merge.
        self.bytes = [[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)]
        self.pairs: dict[int, int] = {}

    def _pair(self, left: int, right: int) -> int:
        """The rank that two neighbours merge to, -1 if they don't merge; from now on known."""
        rank = self.pairs[left << 20 | right] = self.ranks.get(self.table[left] + self.table[right], -1)
        return rank

    def merge(self, data: bytes) -> list[int]:
        """The ids of one pre-token's bytes.

        The rank queue: ``buckets`` holds by rank a position, or a heap of several; ``blocks`` is a
        bitmap of the filled buckets among 1 << SHIFT ranks, ``upper`` a bitmap of the filled blocks.
        """
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n, known, two, bit = len(data), self.pairs, self.bytes, _BIT
        tokens = list(map(self.single.__getitem__, data))
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        #: The rank of each position's pair as it is now; an entry of the queue with another rank is stale.
        now = [two[a][b] for a, b in zip(data, data[1:])]
        now.append(-1)
        upper, blocks, buckets = 0, {}, {}
        for i, rank in enumerate(now):
            if rank >= 0:
                if rank in buckets:
                    _put(buckets, rank, i)
                else:
                    buckets[rank] = i
                    block = rank >> SHIFT
                    blocks[block] = blocks.get(block, 0) | bit[rank & MASK]
                    upper |= 1 << block
        while upper:
            block = (upper & -upper).bit_length() - 1
            bits = blocks[block]
            low = bits & -bits
            rank = (block << SHIFT) + low.bit_length() - 1
            i = buckets[rank]
            if type(i) is list:
                i = _take(buckets, rank)
            else:
                del buckets[rank]
                blocks[block] = bits = bits ^ low
                if not bits:
                    upper &= upper - 1
            if now[i] != rank:
                continue
            j = after[i]
            now[j] = -1
            tokens[i] = rank
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                key = rank << 20 | tokens[k]
                new = now[i] = known[key] if key in known else self._pair(rank, tokens[k])
                if new >= 0:
                    if new in buckets:
                        _put(buckets, new, i)
                    else:
                        buckets[new] = i
                        block = new >> SHIFT
                        blocks[block] = blocks.get(block, 0) | bit[new & MASK]
                        upper |= 1 << block
            else:
                now[i] = -1
            h = before[i]
            if h >= 0:
                key = tokens[h] << 20 | rank
                new = now[h] = known[key] if key in known else self._pair(tokens[h], rank)
                if new >= 0:
                    if new in buckets:
                        _put(buckets, new, h)
                    else:
                        buckets[new] = h
                        block = new >> SHIFT
                        blocks[block] = blocks.get(block, 0) | bit[new & MASK]
                        upper |= 1 << block
        if len(known) > CACHE_PAIRS:
            known.clear()
        out, i = [], 0
        while i < n:
            out.append(tokens[i])
            i = after[i]
        return out

    def encode(self, strings: Iterable[str]) -> list[bytes]:
        merge, collects = self.merge, gc.isenabled()
        gc.disable()  # merges make many short-lived lists and no cycles
        try:
            return [
                array("I", merge(s.encode())).tobytes()
                if ONE_WORD(s)
                else b"".join([array("I", merge(t.encode())).tobytes() for t in self.find(s)])
                for s in strings
            ]
        finally:
            if collects:
                gc.enable()

    def decode(self, ids: pa.Array) -> pa.Array:
        """The bytes that each row of ids stands for."""
        bounds = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
        data = ids.buffers()[2]
        numbers = np.frombuffer(data, np.uint32)[bounds[0] // 4 : bounds[-1] // 4] if bounds[-1] else np.empty(0, np.uint32)
        decoded = self.words.take(pa.array(numbers))
        ends = np.frombuffer(decoded.buffers()[1], np.int64)[(bounds - bounds[0]) // 4]
        return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends.astype(np.int32)), decoded.buffers()[2]])


_coders: dict[tuple[str, str], tuple[BytePairEncoder, PieceEncoder]] = {}


def _coder(path: str, pattern: str) -> tuple[BytePairEncoder, PieceEncoder]:
    if (path, pattern) not in _coders:
        coder = BytePairEncoder(load_ranks(path), pattern)
        _coders[path, pattern] = coder, PieceEncoder(coder.encode)
    return _coders[path, pattern]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` (little-endian unsigned 32-bit) of every whole text.

    No match of the pattern may go on from a character that shows to a space or line end, nor from a
    letter to a mark; the public byte-level pattern has none. Null text counts as empty and has no ids; null ids and repeated
    rows are encoded like any other; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _coder(ranks_path, pattern)[1]
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), encode(part.column("text"))], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded``, the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _coder(ranks_path, pattern)[0].decode
        for batch in batches:
            for part in slices(batch, "ids"):
                yield pa.RecordBatch.from_arrays([*part.columns, decode(part.column("ids"))], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")
