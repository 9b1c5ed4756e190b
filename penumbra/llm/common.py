"""Helpers shared by the text operators: the shared scratch folder, hashing, and file access."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: 64-bit mixing constants (SplitMix64), fixed values.
MIX_1, MIX_2, GOLDEN = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for ``name`` below the folder that driver and executors share.

    The place is the session's ``spark.checkpoint.dir``. Only where that is unset (a
    single-machine test session) a temporary folder is made and set.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="penumbra-"))
        base = sc.getCheckpointDir()
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of ``uri`` and the path inside it."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return pafs.FileSystem.from_uri(uri)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(col: str) -> Column:
    """The text column as a string, null as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser over an unsigned 64-bit array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(31))


#: Bytes of text that a task works on at once; a longer text stands alone.
SLICE_BYTES = 8 << 20


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts without nulls, and the place of each text in them (one more entry than texts)."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: int | str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in runs of about ``size`` bytes of text."""
    if not batch.num_rows:
        return
    bounds = utf8(batch.column(column))[1]
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words (runs of characters other than ASCII white space, with A-Z lower-cased) of a column of texts:
    the distinct words as binary, the number of each word among them in order, and the place of each text's
    first word (one more entry than texts)."""
    data, bounds = utf8(texts)
    if not len(data):
        return pa.array([], pa.binary()), np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    shown = (data != 32) & ((data < 9) | (data > 13))
    first = shown.copy()
    first[1:] &= ~shown[:-1]
    opens = bounds[:-1][bounds[:-1] < len(data)]
    first[opens] = shown[opens]
    starts = np.flatnonzero(first)
    kept = data[shown]
    kept = kept + ((kept >= 65) & (kept <= 90)).astype(np.uint8) * np.uint8(32)
    places = np.append(np.cumsum(shown)[starts] - 1, len(kept)).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(kept)]).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), np.searchsorted(starts, bounds)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
