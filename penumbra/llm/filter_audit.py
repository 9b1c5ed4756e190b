"""How text filters overlap: what each removes in every order of application, from a histogram of failure masks.

Five filters give every document a mask of five bits. All that any order of the filters does follows from
the 32 counts of masks a part, so documents are read once and orders are worked out on the counts. Everything
is DataFrame functions.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penumbra.llm.common import text_or_empty

FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: under 50 words; distinct words under 65 percent; capitals A-Z over 5 percent of the
    characters; one of ``#$%&*|``. Words are runs of characters other than ASCII white space."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    percent = lambda part, whole, limit: F.size(part).cast("long") * 100 < F.size(whole).cast("long") * limit
    bit = lambda fail, i: F.when(fail, F.lit(1 << i)).otherwise(0)
    # One array of words serves both tests; as plain expressions each would split the text anew.
    counted = F.transform(F.array(words), lambda w: bit(F.size(w) < 50, 0) + bit(percent(F.array_distinct(w), w, 65), 1))[0]
    capitals = F.length(text) - F.length(F.translate(text, _UPPER, ""))
    return counted + bit(capitals.cast("long") * 100 > F.length(text).cast("long") * 5, 2) + bit(text.rlike("[#$%&*|]"), 3)


def masked(docs: DataFrame, part_col: str = "source") -> DataFrame:
    """``doc_id, part, mask`` of every row. Bit 4 is set where a smaller id in the whole table has the same text.

    A null text counts as the empty one, a null part as the empty string. A null id is neither smaller than another nor
    has it a smaller one; rows that repeat an id with its text share the decision of that id.
    """
    text = text_or_empty("text")
    sha = F.coalesce(F.sha2("text", 256), F.lit(""))  # never null, so the join needs no filter that hashes again
    # Equal texts merge before the shuffle, so a text of a third of all rows is one row a task.
    firsts = docs.select(F.col("doc_id").cast("long").alias("first"), text.alias("text")).groupBy("text").agg(F.min("first").alias("first"))
    firsts = firsts.where("first is not null").select(F.col("first").alias("doc_id"), sha.alias("sha"), F.lit(True).alias("is_first"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    slim = slim.select("doc_id", "part", text_mask(F.col("text")).alias("mask"), sha.alias("sha"))
    # An id meets its own text only, so the join has no hot key; the hash tells texts of a repeated id apart.
    marked = slim.join(firsts, ["doc_id", "sha"], "left")
    copy = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    return marked.select("doc_id", "part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"))


def mask_cells(docs: DataFrame, labels: DataFrame, part_col: str = "source") -> DataFrame:
    """``part, mask, n, good, toxic``: the documents of a mask, those labelled good (quality 1) and those labelled toxic (1).

    Repeated labels of an id count as 1 where one of them does.
    """
    flags = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    rows = masked(docs, part_col).join(flags, "doc_id", "left")
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c)
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), total("good"), total("toxic"))


def audit(cells: DataFrame) -> DataFrame:
    """One row a part, order and step: ``part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley``, zeros included; a part has rows if it has documents.

    ``kept`` counts the part's documents after the step, ``removed`` those that fall here, ``redundant`` those that fail the
    filter but fell before, ``unique_fails`` those that fail it alone, ``good_lost`` and ``toxic_lost`` the labelled ones that
    fall here, ``shapley`` what the filter removes summed over all orders.
    """
    masks = F.sequence(F.lit(0), F.lit(CELLS - 1))
    counts = cells.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic")))).alias("cell"))
    # Of every set of filters: the documents that fail none of it.
    free = lambda what: F.transform(
        masks, lambda s: F.aggregate(masks, F.lit(0).cast("long"), lambda sum_, m: sum_ + F.when(m.bitwiseAND(s) == 0, F.coalesce(F.col("cell")[m][what], F.lit(0).cast("long"))).otherwise(0))
    )
    unique = F.array(*(F.coalesce(F.col("cell")[1 << bit]["n"], F.lit(0).cast("long")) for bit in range(len(FILTERS))))
    sets = counts.select("part", free("n").alias("free"), free("good").alias("free_good"), free("toxic").alias("free_toxic"), unique.alias("alone"))
    # A filter is preceded by a given set in |set|! (4 - |set|)! orders.
    weighted = []
    for bit in range(len(FILTERS)):
        before = [s for s in range(CELLS) if not s >> bit & 1]
        terms = [(F.col("free")[s] - F.col("free")[s | 1 << bit]) * (factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count())) for s in before]
        weighted.append(sum(terms[1:], terms[0]))
    sets = sets.withColumn("shapleys", F.array(*weighted))
    # The 600 steps as one literal, which is cheaper to plan than thousands of them.
    listed = [
        {
            "filter_order": "".join(order), "step": i + 1, "filter": f, "bit": FILTERS.index(f), "own": 1 << FILTERS.index(f),
            "before": sum(1 << FILTERS.index(g) for g in order[:i]),
        }
        for order in permutations(FILTERS) for i, f in enumerate(order)
    ]
    steps = F.from_json(F.lit(json.dumps(listed)), "array<struct<filter_order:string,step:int,filter:string,bit:int,own:int,before:int>>")
    spread = sets.select("*", F.inline(steps)).withColumn("after", F.col("before") + F.col("own"))
    lost = lambda c: F.col(c)[F.col("before")] - F.col(c)[F.col("after")]
    fails = F.col("free")[0] - F.col("free")[F.col("own")]
    return spread.select(
        "part", "filter_order", "step", "filter", F.col("free")[F.col("after")].alias("kept"), lost("free").alias("removed"),
        (fails - lost("free")).alias("redundant"), F.col("alone")[F.col("bit")].alias("unique_fails"), lost("free_good").alias("good_lost"), lost("free_toxic").alias("toxic_lost"),
        F.col("shapleys")[F.col("bit")].alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, part_col: str = "source") -> DataFrame:
    """The audit of all documents; see :func:`audit`. An empty table gives an empty table; other columns are ignored."""
    return audit(mask_cells(docs, labels, part_col))
