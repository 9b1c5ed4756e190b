"""Near-duplicate groups by SuperMinHash signatures, banding, full verification and union-find.

A document is the set of its distinct word shingles. Words are maximal runs of characters other
than ASCII white space, with A-Z lower-cased. Documents whose sets are equal collapse first, so a
large group of copies costs one representative. Representatives meet in band buckets; a link is
accepted only after the two full sets are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penumbra.llm.common import GOLDEN, materialise, mix64, slices, text_or_empty, words_of

#: Shingles whose permutations a task holds at once (168 bytes each); a longer text is offered in such chunks.
CHUNK = 1 << 16
#: Bytes of text that a task works on at once.
SLICE = 4 << 20


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's ``width``-word shingles.

    A text of fewer words (but at least one) has its whole sequence as its only shingle; a text
    without words has the empty set.
    """
    words, order, bounds = words_of(texts)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_pylist()), np.uint64, len(words))[order]
    out = []
    shingled = _shingles(hashed, width)
    for at, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if end - at >= width:
            out.append(np.unique(shingled[at : end - width + 1]))
        else:
            out.append(_shingles(hashed[at:end], end - at) if end > at else np.empty(0, np.uint64))
    return out


def _shingles(hashed: np.ndarray, width: int) -> np.ndarray:
    """The hash of ``width`` words from each word on."""
    out = np.full(max(0, len(hashed) - width + 1), width, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = mix64(out * np.uint64(GOLDEN) + hashed[i : i + len(out)])
    return out


def _offer(elements: np.ndarray, owner: np.ndarray, best: np.ndarray) -> None:
    """Lower ``best`` (a signature a row) by what the elements of each row's set offer.

    Step j of an element's random permutation offers the value j + u to one position. All elements
    take step j together. A set is done when all its positions hold less than j + 1, because later
    steps only offer more.
    """
    m = best.shape[1]
    flat = best.reshape(-1)
    perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(elements), 1))
    rows = np.arange(len(elements))
    with np.errstate(over="ignore"):
        for j in range(m):
            bits = mix64(elements + np.uint64((j + 1) * GOLDEN & 0xFFFFFFFFFFFFFFFF))
            value = (bits >> np.uint64(32)).astype(np.float64) / 4294967296.0 + j
            k = j + ((bits & np.uint64(0xFFFFFFFF)) % np.uint64(m - j)).astype(np.int64)
            at = perm[rows, k]
            perm[rows, k] = perm[:, j]
            np.minimum.at(flat, owner * m + at, value)
            on = (best.max(1) >= j + 1)[owner]
            left = int(on.sum())
            if not left:
                return
            if left < 0.7 * len(on):
                elements, owner, perm, rows = elements[on], owner[on], perm[on], rows[:left]


def superminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures (Ertl 2017), a row a set of 64-bit hashes; an empty set's row is infinite."""
    best = np.full((len(sets), m), np.inf)
    first = held = 0
    for i, s in enumerate(sets):
        held += len(s)
        if held >= CHUNK or i == len(sets) - 1:
            elements = np.concatenate(sets[first : i + 1])
            owner = np.repeat(np.arange(i + 1 - first), [len(x) for x in sets[first : i + 1]])
            for at in range(0, len(elements), CHUNK):
                _offer(elements[at : at + CHUNK], owner[at : at + CHUNK], best[first : i + 1])
            first, held = i + 1, 0
    return best


def banding(threshold: float, slots: int = 168, miss: float = 1e-5) -> tuple[int, int]:
    """Bands and rows a band: the most rows with which a pair at the threshold is missed with
    a probability of at most ``miss``."""
    rows = max(r for r in range(1, 33) if (1 - threshold**r) ** (slots // r) <= miss or r == 1)
    return slots // rows, rows


def _signatures(width: int, bands: int, rows: int):
    names, types = ["doc_id", "print", "n_shingles", "keys"], [pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size=SLICE):
                sets = shingle_sets(part.column("text"), width)
                prints = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                best = superminhash(sets, bands * rows).reshape(len(sets), bands, rows)
                keys = [
                    [xxhash.xxh3_64_intdigest(p.tobytes(), i) - (1 << 63) for i, p in enumerate(b)] if len(s) else []
                    for s, b in zip(sets, best, strict=True)
                ]
                columns = [part.column("doc_id"), prints, list(map(len, sets)), keys]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size=SLICE):
                sets = shingle_sets(part.column("text"), width)
                prints = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
                bounds = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                values = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([prints, pa.ListArray.from_arrays(bounds, values)], ["print", "shingles"])

    return run


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, comp)`` for the nodes of undirected ``edges(a, b)``; comp is the smallest node reachable.

    Distributed union-find by large-star and small-star steps (Kiveris et al. 2014): every round
    hooks neighbours onto the smallest one known. The rounds end when the edges are stars: every
    node is either a root or hangs from one root. Each round is written to the shared folder.
    """
    e = materialise(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc"
    )
    for _ in range(rounds):
        ends = e.select(F.col("u").alias("n"), F.lit(1).alias("hangs")).union(e.select("v", F.lit(0)))
        roles = ends.groupBy("n").agg(F.sum("hangs").alias("hangs"), F.count("*").alias("all"))
        if not roles.where("hangs > 1 or (hangs = 1 and all > 1)").limit(1).count():
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select("v", "v").distinct())
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = materialise(
            small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .distinct(),
            "cc",
        )
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets reach the similarity."""
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .select("a", "b", both.alias("i"), (F.size("sa") + F.size("sb") - both).alias("u"))
        .where(F.lit(100) * F.col("i") >= F.lit(percent) * F.col("u"))
        .select("a", "b")
    )


def _close(percent: int, other: str) -> Column:
    """Sizes and places of a shared shingle that allow the similarity. Two sets agree on at most what stands at and after
    the first shingle that they share."""
    n, m = F.col("n"), F.col(f"{other}.n")
    left = F.least(n - F.col("pos"), m - F.col(f"{other}.pos"))
    return (F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)) & (F.lit(100 + percent) * left >= F.lit(percent) * (n + m))


def _pair(other: str) -> list[Column]:
    return [F.least("rep", f"{other}.rep").alias("a"), F.greatest("rep", f"{other}.rep").alias("b")]


def _rarest(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(rep, n, h, pos)``: the shingles that narrow the pairs of ``members(rep, comp)`` in different components.

    Nothing is lost: a pair at the threshold shares one of the rarest ``n - ceil(t * n) + 1`` shingles
    of both sets (rare among the members; those that one member has alone stand first).
    """
    postings = sets.join(members, "rep").select("rep", "comp", F.size("shingles").alias("n"), F.explode("shingles").alias("h"))
    common = postings.groupBy("h").agg(F.count("*").alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("df > 1")
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("list"))
    return (
        postings.join(common, "h")
        .groupBy("rep", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "h", (F.col("lo") != F.col("hi")).alias("mixed")))).alias("list"))
        .where(first > 0)
        .select("rep", "n", (F.col("n") - F.size("list")).alias("before"), F.slice("list", F.lit(1), first.cast("int")).alias("list"))
        .select("rep", "n", "before", F.posexplode("list").alias("i", "s"))
        .where("s.mixed")
        .select("rep", "n", F.col("s.h").alias("h"), (F.col("before") + F.col("i")).alias("pos"))
    )


def _lists(rarest: DataFrame, members: DataFrame, pick) -> DataFrame:
    """The lists of shingles whose members lie in several components, with one member ``c`` of the list."""
    rows = rarest.join(members.select("rep", "comp"), "rep")
    mixed = rows.groupBy("h").agg(pick(F.struct("pos", "rep", "comp", "n")).alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    return rows.join(mixed.where("lo <> hi").select("h", "c"), "h")


def _star(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs of a list's members with its one member, across components."""
    return lists.where((F.col("comp") != F.col("c.comp")) & _close(percent, "c")).select(_pair("c")).distinct()


def _across(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs of a list's members that lie outside its one member's component with all of the list, across components."""
    others = lists.select("h", F.struct("pos", "rep", "comp", "n").alias("o"))
    once = (F.col("o.comp") == F.col("c.comp")) | (F.col("o.rep") < F.col("rep"))
    outside = lists.where(F.col("comp") != F.col("c.comp"))
    return outside.join(others, "h").where((F.col("comp") != F.col("o.comp")) & once & _close(percent, "o")).select(_pair("o")).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 85
) -> DataFrame:
    """Groups of documents linked by ``100 * intersection >= percent * union`` of shingle sets.

    Returns one row a document: ``doc_id``, ``n_shingles``, ``component_id`` (the smallest id
    reachable over links) and ``kept`` (the id equals it). Null text counts as empty. A document
    without words is linked with nothing. Every row is judged by its own text, so repeated ids may
    stand in several components; a null id ranks behind all others, is the component of a group
    that has no other, and is kept there. Other columns are ignored, so their names cannot clash. An
    empty table gives an empty table. A text takes about 40 bytes a word while it is read.

    1. Signatures (SuperMinHash) and band keys per document; equal sets collapse to one representative.
    2. Every band bucket is a star: its members are candidates with the bucket's first member.
       Links are confirmed on the full sets; union-find joins them.
    3. Buckets whose members now lie in several components are unsettled. Pairs of their members across
       components are narrowed without loss by rare shingles, confirmed on the full sets, and
       union-find goes on over the components: twice with one member of each shingle's list, so
       that a large group grows together, then with all that is left. Pairs inside one component
       need no further look.
    """
    bands, rows = banding(percent / 100)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    prep = base.mapInArrow(_signatures(width, bands, rows), "doc_id long, print binary, n_shingles long, keys array<long>")
    prep = materialise(prep.withColumn("row", F.monotonically_increasing_id()), "signatures")
    known = prep.where("n_shingles > 0")
    reps = known.groupBy("print").agg(
        F.min("row").alias("rep"), F.min("doc_id").alias("low"), F.min("n_shingles").alias("n"), F.first("keys").alias("keys")
    )
    reps = materialise(reps, "representatives")
    bucket = reps.select("rep", "n", F.explode("keys").alias("key"))
    centre = bucket.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("c"), F.count("*").alias("size")).where("size > 1")
    met = materialise(bucket.join(centre.select("key", "c"), "key").select("key", "rep", "n", F.col("c.rep").alias("centre"), F.col("c.n").alias("n2")), "buckets")
    close = F.lit(100) * F.least("n", "n2") >= F.lit(percent) * F.greatest("n", "n2")
    stars = met.where((F.col("rep") != F.col("centre")) & close).select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    wanted = reps.join(met.select("rep").distinct(), "rep", "left_semi").select("print", "rep", "low")
    # The text of any row whose set is wanted will do: it is found by the row's id and known by its print.
    texts = base.withColumn("key", F.coalesce("doc_id", F.lit(-1))).join(
        wanted.select(F.coalesce("low", F.lit(-1)).alias("key")).distinct(), "key", "left_semi"
    )
    sets = texts.select("text").mapInArrow(_sets(width), "print binary, shingles array<long>")
    sets = materialise(sets.join(wanted.select("print", "rep"), "print").dropDuplicates(["print"]).select("rep", "shingles"), "sets")
    links = materialise(_verified(stars, sets, percent), "links")
    comp = connected_components(links).toDF("rep", "comp")
    labelled = met.select("key", "rep").join(comp, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    unsettled = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    members = labelled.join(unsettled, "key").select("rep", "comp").distinct()
    members = materialise(members.withColumn("began", F.col("comp")), "unsettled")
    rarest = materialise(_rarest(members, sets, percent), "rarest")
    # First stars around one member of each list, then around another; what is left outside is compared with all.
    for pairs_of, pick in ((_star, F.min), (_star, F.max), (_across, F.min)):
        crossing = materialise(_verified(pairs_of(_lists(rarest, members, pick), percent), sets, percent), "links")
        # Components are joined, not documents: union-find goes on over their names.
        name = members.select("rep", "comp")
        joined = crossing.join(name.toDF("a", "ca"), "a").join(name.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        merged = connected_components(joined).toDF("comp", "last")
        members = materialise(members.join(merged, "comp", "left").select("rep", F.coalesce("last", "comp").alias("comp"), "began"), "unsettled")
    merged = members.where("began <> comp").select(F.col("began").alias("comp"), F.col("comp").alias("last")).distinct()
    named = reps.select("print", "rep", "low").join(comp, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    named = named.join(merged, "comp", "left").select("print", "low", F.coalesce("last", "comp").alias("comp"))
    lowest = named.groupBy("comp").agg(F.min("low").alias("component_id"))
    classes = named.join(lowest, "comp").select("print", "component_id")
    linked = known.select("doc_id", "n_shingles", "print").join(classes, "print").select("doc_id", "n_shingles", "component_id")
    alone = prep.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
