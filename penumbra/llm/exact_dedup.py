"""Exact duplicates through an extendible-hash index on the shared file system.

Every map task first merges its own equal texts, so a text with any number of copies reaches its
owner at most once a slice of input. Owner tasks hold disjoint ranges of the 64-bit key space. An
owner inserts texts into an extendible hash: a directory addressed by leading key bits points to
buckets, an overfull bucket splits and doubles the directory where its own depth has reached the
directory's; texts whose keys collide are chained and told apart by their bytes. The finished
index (directory and buckets) is written to the shared folder, so that later rows can be probed.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from penumbra.llm.common import open_fs, shared_folder, shuffle_partitions, slices, text_or_empty

#: Text bytes in a bucket before it splits, and in an owner's memory before buckets move to files.
BUCKET_BYTES = 1 << 20
OWNER_BYTES = 96 << 20
#: Text bytes in which a map task looks for copies at once, and text bytes to an owner task.
MERGE_BYTES, TASK_BYTES = 12 << 20, 256 << 20

_ENTRY = pa.schema(
    [("key", pa.uint64()), ("sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("text", pa.binary())]
)


class Bucket:
    """Entries whose keys share ``depth`` leading bits: chains of ``[text, keep_id, count]`` by key."""

    def __init__(self, depth: int):
        self.depth, self.chains, self.bytes, self.file = depth, {}, 0, None

    def table(self) -> pa.Table:
        rows = [(k, hashlib.sha256(t).hexdigest(), keep, n, t) for k, chain in self.chains.items() for t, keep, n in chain]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ENTRY, strict=True)], schema=_ENTRY)


class ExtendibleIndex:
    """An extendible hash of texts over keys that share ``skip`` leading bits."""

    def __init__(self, uri: str, skip: int, bucket_bytes: int = BUCKET_BYTES, memory: int = OWNER_BYTES):
        self.fs, self.path = open_fs(uri)
        self.skip, self.bucket_bytes, self.memory = skip, bucket_bytes, memory
        self.depth, self.directory = 0, [Bucket(0)]
        self.held = self.files = 0

    def _slot(self, key: int) -> int:
        return (key << self.skip & 0xFFFFFFFFFFFFFFFF) >> (64 - self.depth) if self.depth else 0

    def insert(self, key: int, text: bytes, keep: int | None, count: int) -> None:
        bucket = self.directory[self._slot(key)]
        self._load(bucket)
        chain = bucket.chains.setdefault(key, [])
        for entry in chain:
            if entry[0] == text:
                entry[1] = keep if entry[1] is None else entry[1] if keep is None else max(entry[1], keep)
                entry[2] += count
                return
        chain.append([text, keep, count])
        bucket.bytes += len(text) + 64
        self.held += len(text) + 64
        while bucket.bytes > self.bucket_bytes and len(bucket.chains) > 1 and bucket.depth + self.skip < 64:
            self._split(bucket)
            bucket = self.directory[self._slot(key)]
        if self.held > self.memory:
            self._evict(bucket)

    def _split(self, old: Bucket) -> None:
        if old.depth == self.depth:
            self.directory = [b for b in self.directory for _ in range(2)]
            self.depth += 1
        halves = [Bucket(old.depth + 1), Bucket(old.depth + 1)]
        for key, chain in old.chains.items():
            half = halves[(key << self.skip & 0xFFFFFFFFFFFFFFFF) >> (63 - old.depth) & 1]
            half.chains[key] = chain
            half.bytes += sum(len(e[0]) + 64 for e in chain)
        seen = [i for i, b in enumerate(self.directory) if b is old]
        for n, i in enumerate(seen):
            self.directory[i] = halves[n >= len(seen) // 2]

    def _buckets(self) -> list[Bucket]:
        return list({id(b): b for b in self.directory}.values())

    def _evict(self, current: Bucket) -> None:
        """Write every bucket but the current one to its file and drop it from memory."""
        for b in self._buckets():
            if b is not current and b.file is None and b.chains:
                self._write(b)
                self.held -= b.bytes
                b.chains = {}

    def _load(self, bucket: Bucket) -> None:
        if bucket.file is not None:
            with self.fs.open_input_file(bucket.file) as f:
                for r in pq.read_table(f).to_pylist():
                    bucket.chains.setdefault(r["key"], []).append([r["text"], r["keep_id"], r["group_size"]])
            self.fs.delete_file(bucket.file)
            self.held += bucket.bytes
            bucket.file = None

    def _write(self, bucket: Bucket) -> None:
        self.fs.create_dir(self.path, recursive=True)
        bucket.file = f"{self.path}/bucket-{self.files:06d}.parquet"
        self.files += 1
        out = io.BytesIO()
        pq.write_table(bucket.table(), out, compression="zstd")
        with self.fs.open_output_stream(bucket.file) as f:
            f.write(out.getvalue())

    def close(self) -> Iterator[pa.Table]:
        """Write all buckets and the directory; give each bucket's entries without the texts."""
        buckets = [b for b in self._buckets() if b.chains or b.file]
        for b in buckets:
            if b.file is None:
                table = b.table()
                self._write(b)
                b.chains = {}
            else:
                with self.fs.open_input_file(b.file) as f:
                    table = pq.read_table(f)
            yield table.select(["sha256", "keep_id", "group_size"])
        names = {id(b): b.file.rpartition("/")[2] for b in buckets}
        with self.fs.open_output_stream(f"{self.path}/directory") as f:
            f.write("\n".join(names.get(id(b), "-") for b in self.directory).encode())


def _key(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal texts of a slice of the input as one row."""
    for batch in (part for whole in batches for part in slices(whole, size=MERGE_BYTES)):
        t = pa.table({"text": pc.cast(batch.column("text"), pa.large_binary()), "id": batch.column("doc_id"), "one": pa.array([1] * batch.num_rows, pa.int64())})
        g = t.group_by("text").aggregate([("id", "max"), ("one", "sum")]).combine_chunks()
        texts = g.column("text").to_pylist()
        keys = pa.array([_key(x) for x in texts], pa.uint64()).view(pa.int64())
        for c in pa.table({"key": keys, "text": pa.array(texts, pa.binary()), "keep_id": g.column("id_max"), "n": g.column("one_sum")}).to_batches():
            yield c


def _own(index_uri: str, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        owners: dict[int, ExtendibleIndex] = {}
        for batch in batches:
            keys = batch.column("key").view(pa.uint64()).to_pylist()
            for key, text, keep, n in zip(keys, batch.column("text"), batch.column("keep_id").to_pylist(), batch.column("n").to_pylist(), strict=True):
                owner = key >> (64 - bits) if bits else 0
                if owner not in owners:
                    # An attempt has a folder of its own, so a task that runs again never meets half-written files.
                    owners[owner] = ExtendibleIndex(f"{index_uri}/owner={owner:06d}/attempt={task.taskAttemptId()}", bits)
                owners[owner].insert(key, text.as_py(), keep, n)
        for index in owners.values():
            for table in index.close():
                yield from table.combine_chunks().to_batches()

    return run


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index_uri: str | None = None) -> DataFrame:
    """One row a distinct text: ``text_sha256``, ``keep_id`` (the largest id) and ``group_size``.

    The index files are left in ``index_uri`` (a new shared folder by default).
    """
    spark = docs.sparkSession
    index_uri = index_uri or shared_folder(spark, "text-index")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(shuffle_partitions(spark), -(-size // TASK_BYTES))
    bits = max(0, (partitions - 1).bit_length() + 1)
    merged = rows.mapInArrow(_merge, "key long, text binary, keep_id long, n long")
    owned = merged.repartition(partitions, F.shiftrightunsigned("key", 64 - bits))
    return owned.mapInArrow(_own(index_uri, bits), "text_sha256 string, keep_id long, group_size long")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index_uri: str | None = None) -> DataFrame:
    """One row a document: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when their UTF-8 bytes are; null counts as empty. The row with the largest id
    of a group stays. A null id ranks below every other: its row stays only in a group of null ids,
    where all rows stay. Repeated rows of the id that stays are all marked as kept. Other columns
    are ignored. An empty table gives an empty table.
    """
    groups = duplicate_groups(docs, id_col, text_col, index_uri)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(text_or_empty(text_col), 256).alias("text_sha256"))
    return rows.join(groups, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
