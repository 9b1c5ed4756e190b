"""The corpus pipeline: every stage reads the table that the stage before it wrote.

Stages need the columns ``doc_id`` and ``text`` and hand on all columns, whatever their names; null and
empty texts, null and repeated ids and empty tables pass through each.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penumbra.llm import exact_dedup, packing, personal_data, toxicity
from penumbra.llm.common import materialise, shared_folder, text_or_empty
from penumbra.llm.near_dedup import near_duplicates

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

def _free(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one, that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _numbered(docs: DataFrame, row: str) -> DataFrame:
    """``docs`` with a number in column ``row`` that no other row has, ascending with the id (null ids last): the id
    itself where ids are unique and none is null, else a number that is written with the rows."""
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id is null or n > 1")
    if not odd.limit(1).count():
        return docs.withColumn(row, F.col("doc_id").cast("long"))
    return materialise(docs.orderBy(F.col("doc_id").asc_nulls_last()).withColumn(row, F.monotonically_increasing_id()), "numbered")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the model calls toxic go; each is judged by its own text. It learns from the labelled rows of ``docs``."""
    return toxicity.drop(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays (a null id ranks below every other); of repeated rows of that id, one.

    Rows meet the decision by text and id, so neither another text of an id nor another row without one counts.
    """
    sha, keep, text = (_free(docs, name) for name in ("sha", "keep", "group_text"))
    groups = exact_dedup.duplicate_groups(docs).select(F.col("text_sha256").alias(text), F.col("keep_id").alias(keep))
    rows = docs.withColumn(sha, F.sha2(text_or_empty("text"), 256))
    same = (F.col(sha) == F.col(text)) & F.col("doc_id").cast("long").eqNullSafe(F.col(keep))
    return rows.join(materialise(groups, "kept"), same, "left_semi").dropDuplicates(["doc_id", sha]).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays, that of the smallest id (null ids last): five-word shingles, similarity 0.8.

    Rows take part under numbers of their own, so repeated and missing ids don't matter.
    """
    row = _free(docs, "row")
    rows = _numbered(docs, row)
    groups = near_duplicates(rows, id_col=row, width=5, percent=80)
    kept = materialise(groups.where("kept").select(F.col("doc_id").alias(row)), "kept")
    return rows.join(kept, row, "left_semi").select(docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind and ``n_chars`` follows; every row stays, a null text null."""
    redacted = personal_data.redact(docs)
    return redacted.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else redacted


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as packed sequences of at most 2048 tokens: one row a piece, with its ids."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, window=2048)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("pii", redact_personal_data),
    ("packing", pack),
]

#: Signatures, trained models and packing have no SQL form; the tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
