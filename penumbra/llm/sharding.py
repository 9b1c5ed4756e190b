"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

The row number of a document is its place in the order of ids. A Feistel network over a x b
numbers, where a x b is the least such rectangle near a square that holds all rows, permutes them;
a number outside the rows walks on along its cycle until it is inside. Shard and slot of a row are
remainder and quotient of its permuted number, so both can be computed for any row number, and the
inverse network finds the row in any slot. Everything is DataFrame expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penumbra.llm.common import shuffle_partitions, text_or_empty

#: Rounds, and the multipliers and moduli of the round function; fixed values. Products stay below 2**63.
ROUNDS = 6
MULTIPLIERS = (1103515245, 1664525, 22695477, 69069, 134775813, 1220703125)
MODULUS = 2147483647
SECOND_MODULUS = 2147483629


def domain(rows: int) -> tuple[int, int]:
    """Sides a, b of the permuted rectangle: a * b >= rows, with fewer than a numbers to spare."""
    a = max(1, math.isqrt(max(rows - 1, 0)) + 1)
    return a, max(1, -(-rows // a))


def _long(value: int) -> Column:
    """A long literal: operands of one type need no coercion, which settles one level of a deep expression a pass."""
    return F.lit(value).cast("long")


def _round(value: Column, i: int, seed: int, side: int) -> Column:
    """Two affine maps under different prime moduli; it names its argument once, which keeps a network small."""
    x = (value % _long(MODULUS) + _long((seed * 7919 + i * 104729) % MODULUS)) % _long(MODULUS)
    x = (x * _long(MULTIPLIERS[i]) + _long(12345)) % _long(MODULUS)
    return x * _long(MULTIPLIERS[(i + 1) % ROUNDS]) % _long(SECOND_MODULUS) % _long(side)


def _network(number: Column, rows: int, seed: int, inverse: bool = False) -> Column:
    """One pass over a number = left * b + right: rounds add to left modulo a and to right modulo b in turn.

    Exact below 2**53 rows.
    """
    a, b = domain(rows)
    right = number % _long(b)
    half = {"l": ((number - right) / _long(b)).cast("long"), "r": right}
    for i in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
        one, other, side = ("l", "r", a) if i % 2 == 0 else ("r", "l", b)
        value = _round(half[other], i, seed, side)
        half[one] = F.pmod(half[one] - value if inverse else half[one] + value, _long(side)).cast("long")
    return half["l"] * _long(b) + half["r"]


def permuted(number: Column, rows: int, seed: int = 0, inverse: bool = False) -> Column:
    """The place of row ``number`` among ``rows``, or with ``inverse`` the row at that place.

    A walk leaves the spare numbers after at most as many steps as there are spare numbers, so the
    loop over that many steps is exact; only the few rows that start outside run it.
    """
    a, b = domain(rows)
    spare = a * b - rows
    once = _network(number.cast("long"), rows, seed, inverse)
    if not spare:
        return once
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(spare)),
        once,
        lambda at, _: F.when(at >= _long(rows), _network(at, rows, seed, inverse)).otherwise(at),
    )
    return F.when(once < _long(rows), once).otherwise(walk)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``row_number`` (long, from 0) in the order of the columns, without one task
    seeing all rows: range partitions are numbered inside and offset by the partitions before.

    The numbered partitions go to the checkpoint folder first, so a task that runs again can't
    number differently. Rows equal in every column of ``order`` are dealt evenly too.
    """
    spark = rows.sparkSession
    tie = F.monotonically_increasing_id()
    placed = (
        rows.withColumn("_tie", tie)
        .repartitionByRange(shuffle_partitions(spark), *order, "_tie")
        .sortWithinPartitions(*order, "_tie")
        .drop("_tie")
        .withColumn("_at", F.monotonically_increasing_id())
        .checkpoint()
    )
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(before), "_part")  # a row a partition
        .withColumn("row_number", F.col("_before") + (F.col("_at") - F.shiftleft("_part", 33)))
        .drop("_part", "_at", "_before")
    )


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal all documents into ``shards`` under the law ``rows``: counts at most one apart.

    Returns ``doc_id``, ``size`` (UTF-8 bytes of the text plus 16), ``text_crc32``, ``law``,
    ``shard``, ``slot`` (gapless from 0 in each shard), ``grown_shard`` (null under this law) and
    ``row_number``. Null text counts as no bytes; null ids come first; repeated rows take places of
    their own; other columns are ignored; an empty table gives an empty table. The law has no
    groups, so any number of copies of a text is dealt evenly.
    """
    text = text_or_empty(text_col)
    slim = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    order = numbered(slim, ["doc_id", "size", "text_crc32"])
    rows = order.count()
    place = permuted(F.col("row_number"), rows, seed) if rows else F.col("row_number")
    return order.withColumn("_place", place).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("_place") % shards).cast("int").alias("shard"),
        ((F.col("_place") - F.col("_place") % shards) / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )
