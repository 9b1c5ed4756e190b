"""Token-id files: one zstandard frame a document, with a trailing seek table and checksums.

A file is a run of independent frames, a skippable frame with the document ids, and the seek
table of the public seekable zstandard format: per frame the compressed size, the plain size and
the low 32 bits of the content's XXH64. A reader takes the table from the file's end, computes
the place of any document and decompresses that frame alone.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from penumbra.llm.common import materialise, open_fs, shared_folder, shuffle_partitions, slices, text_or_empty
from penumbra.llm.tokens import file_encoder

#: Magic numbers of the seekable format and of the skippable frame with the ids; fixed values.
SEEK_MAGIC, SKIPPABLE_SEEK, SKIPPABLE_IDS = 0x8F92EAB1, 0x184D2A5E, 0x184D2A50
#: Bit 7 of the seek table's descriptor: the entries hold checksums; fixed value.
HAS_CHECKSUMS = 0x80
LEVEL = 3
#: Compressed bytes after which a writer begins another file.
FILE_BYTES = 256 << 20


class FrameWriter:
    """Appends documents to an open binary file; ``finish`` writes ids and seek table."""

    def __init__(self, out, id_bytes: int):
        self.out, self.dtype, self.ids, self.entries, self.tokens, self.bytes = out, f"<u{id_bytes}", [], [], 0, 0
        self.compress = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False).compress

    def add(self, doc_id: int | None, tokens: np.ndarray) -> None:
        plain = tokens.astype(self.dtype).tobytes()
        frame = self.compress(plain)
        self.out.write(frame)
        self.ids.append(doc_id)
        self.tokens += len(tokens)
        self.bytes += len(frame)
        self.entries.append(struct.pack("<III", len(frame), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))

    def finish(self) -> None:
        known = np.array([i is not None for i in self.ids], np.uint8)
        values = np.array([i or 0 for i in self.ids], "<i8")
        body = struct.pack("<II", int(self.dtype[2]), len(self.ids)) + known.tobytes() + values.tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE_IDS, len(body)) + body)
        table = b"".join(self.entries) + struct.pack("<IBI", len(self.entries), HAS_CHECKSUMS, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)


class FrameReader:
    """Random access to the documents of one file."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        count, flags, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
        if magic != SEEK_MAGIC or not flags & HAS_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        table = size - 9 - 12 * count
        self.entries = np.frombuffer(file.read_at(12 * count, table), "<u4").reshape(count, 3).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.entries[:, 0])])
        body = file.read_at(table - 8 - int(self.offsets[-1]) - 8, int(self.offsets[-1]) + 8)
        width, n = struct.unpack_from("<II", body)
        self.dtype = f"<u{width}"
        known = np.frombuffer(body, np.uint8, n, 8)
        values = np.frombuffer(body, "<i8", n, 8 + n)
        self.ids = [int(v) if k else None for v, k in zip(values, known, strict=True)]
        self.lengths = self.entries[:, 1] // width
        self.decompress = zstandard.ZstdDecompressor().decompress

    def tokens(self, i: int) -> np.ndarray:
        """The ids of the i-th document; only its frame is read and decompressed."""
        size, plain_size, check = map(int, self.entries[i])
        plain = self.decompress(self.file.read_at(size, int(self.offsets[i])), max_output_size=plain_size) if plain_size else b""
        if len(plain) != plain_size or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} does not match its checksum")
        return np.frombuffer(plain, self.dtype)


def _write(path: str, folder: str, end_id: int, id_bytes: int, file_bytes: int):
    names, types = ["part", "number", "file", "documents", "tokens"], [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        encode, end = file_encoder(path), np.array([end_id], np.uint32)
        writer, number, rows = None, 0, []

        def finish() -> None:
            writer.finish()
            writer.out.close()
            name = f"tokens-{part:06d}-{number:04d}.zst"
            fs.move(f"{root}/.{name}-{attempt}", f"{root}/{name}")  # whole or not at all, and the same bytes whichever attempt is last
            rows.append((part, number, name, len(writer.ids), writer.tokens))

        for batch in batches:
            for rows_in in slices(batch):
                for doc_id, raw in zip(rows_in.column("doc_id").to_pylist(), encode(rows_in.column("text")), strict=True):
                    if writer is None:
                        fs.create_dir(root, recursive=True)
                        writer = FrameWriter(fs.open_output_stream(f"{root}/.tokens-{part:06d}-{number:04d}.zst-{attempt}"), id_bytes)
                    writer.add(doc_id, np.append(np.frombuffer(raw.as_buffer(), np.uint32), end))
                    if writer.bytes >= file_bytes:
                        finish()
                        writer, number = None, number + 1
        if writer is not None:
            finish()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


def write_token_files(
    docs: DataFrame, tokenizer_path: str, end_id: int, vocabulary: int = 50257, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, file_bytes: int = FILE_BYTES
) -> tuple[str, DataFrame]:
    """Encode all texts and write them in ascending id order; gives the folder and the manifest
    (``part``, ``number``, ``file``, ``documents``, ``tokens``, ``before``: ids in the files before). A task begins
    another file when one holds ``file_bytes``, so files and their tables stay bounded at any input.

    Null text counts as empty (the end id alone); null ids come first; repeated rows are all
    written; other columns are ignored; an empty table gives no files. Ids take two bytes where the
    vocabulary allows.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "token-files")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange(shuffle_partitions(spark), "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").drop("_tie")
    id_bytes = 2 if max(vocabulary, end_id + 1) <= 1 << 16 else 4
    manifest = materialise(
        ranged.mapInArrow(_write(tokenizer_path, folder, end_id, id_bytes, file_bytes), "part int, number int, file string, documents long, tokens long"), "manifest"
    )
    before = F.sum("tokens").over(Window.orderBy("part", "number")) - F.col("tokens")  # a row a file
    return folder, manifest.withColumn("before", before)


def read_token_files(folder: str, manifest: DataFrame, wanted: Iterable[int] | None = None) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before), ``n_tokens`` and ``ids`` (little-endian
    unsigned 32-bit integers). With ``wanted`` only those documents are decompressed."""
    chosen = None if wanted is None else frozenset(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        names = ["doc_id", "start", "n_tokens", "ids"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for name, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{name}") as f:
                    reader = FrameReader(f)
                    starts = before + np.concatenate([[0], np.cumsum(reader.lengths)])
                    rows, held = [], 0
                    for i, doc_id in enumerate(reader.ids):
                        if chosen is not None and doc_id not in chosen:
                            continue
                        ids = reader.tokens(i).astype("<u4").tobytes()
                        rows.append((doc_id, int(starts[i]), len(ids) // 4, ids))
                        held += len(ids)
                        if held > 1 << 23:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    spread = manifest.select("file", "before").repartition(shuffle_partitions(manifest.sparkSession), "file")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


