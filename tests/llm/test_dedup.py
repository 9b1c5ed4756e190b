"""Exact and near duplicates against brute force."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from support import DATA, same_rows

from penumbra.llm import exact_dedup, near_dedup, queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_against_sql(spark, duck, name):
    same_rows(queries.QUERIES[name](spark, DATA), duck, queries.ORACLE_SQL[name])


def test_exact_odd_rows(odd_documents, no_documents):
    rows = exact_dedup.exact_duplicates(odd_documents).collect()
    got = sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in rows)
    assert len(rows) == 12
    assert got[:5] == [(0, None, 1, True), (1, 2, 3, False), (2, 2, 3, True), (2, 2, 3, True), (3, 4, 2, False)]
    assert exact_dedup.exact_duplicates(no_documents).count() == 0


def test_index_splits_chains_and_reloads(tmp_path):
    index = exact_dedup.ExtendibleIndex(f"file://{tmp_path}/i", 0, bucket_bytes=2_000, memory=6_000)
    expected = defaultdict(lambda: [None, 0])
    random.seed(1)
    for i in range(600):
        text = f"text {random.randrange(150)}".encode() * 5
        # Few keys, so that different texts collide and are told apart by their bytes.
        index.insert((hash(text) % 40) * (1 << 58) % (1 << 64), text, i, 1)
        e = expected[text]
        e[0], e[1] = i, e[1] + 1
    rows = [r for t in index.close() for r in t.to_pylist()]
    assert sorted((r["keep_id"], r["group_size"]) for r in rows) == sorted(tuple(v) for v in expected.values())
    assert index.depth > 0 and index.files > 1


def _words(text):
    return text.encode().lower().split()


def brute_components(rows, width, percent):
    sets = {}
    for i, text in rows:
        w = _words(text or "")
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_families_against_brute_force(spark, width, percent):
    """Families of edited copies, so that pairs lie on both sides of the threshold."""
    random.seed(7)
    rows = []
    for family in range(6):
        base = [f"w{random.randrange(400)}" for _ in range(60 + 40 * family)]
        for _ in range(25):
            words = list(base)
            for _ in range(random.randrange(0, 5)):
                words[random.randrange(len(words))] = f"n{random.randrange(9000)}"
            rows.append((len(rows), " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(frame, width=width, percent=percent).collect()}
    assert got == brute_components(rows, width, percent)


def test_near_odd_rows(odd_documents, no_documents):
    rows = near_dedup.near_duplicates(odd_documents).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows}
    assert len(rows) == 12
    assert got[1] == (8, 1, True) and got[2] == (8, 1, False) and got[8] == (8, 1, False)
    assert got[3] == (0, 3, True) and got[4] == (0, 4, True) and got[5] == (1, 5, True) and got[None][1:] == (None, True)
    assert near_dedup.near_duplicates(no_documents).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    shared = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    a = np.unique(np.concatenate([shared, rng.integers(0, 1 << 63, 60, dtype=np.uint64)]))
    b = np.unique(np.concatenate([shared, rng.integers(0, 1 << 63, 60, dtype=np.uint64)]))
    one, other = near_dedup.superminhash([a, b], 256)
    equal = (one == other).mean()
    assert abs(equal - 300 / 420) < 0.1
    few = near_dedup.superminhash([a[:2]], 64)[0]
    assert np.isfinite(few).all() and len(np.unique(few.astype(int))) > 20  # a small set fills all positions


def test_signature_of_a_long_set_is_offered_in_chunks(monkeypatch):
    sets = [np.unique(np.random.default_rng(i).integers(0, 1 << 63, n, dtype=np.uint64)) for i, n in enumerate((5, 3000, 0, 700, 40))]
    whole = near_dedup.superminhash(sets, 168)
    monkeypatch.setattr(near_dedup, "CHUNK", 512)
    assert np.array_equal(whole, near_dedup.superminhash(sets, 168))


def test_near_repeated_and_missing_ids_are_rows_of_their_own(spark):
    """Two texts of one id, rows without an id, and their copies: each row by its own text."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, a), (5, b), (9, a + " x"), (7, b), (None, b + " y"), (None, "c d e f"), (None, "c d e f")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.component_id, r.kept) for r in near_dedup.near_duplicates(frame).collect()), key=repr)
    assert got == sorted([(5, 5, True), (5, 5, True), (9, 5, False), (7, 5, False), (0, 5, False), (0, None, True), (0, None, True)], key=repr)


def test_banding_misses_little():
    for t in (0.8, 0.85, 0.5):
        bands, rows = near_dedup.banding(t)
        assert (1 - t**rows) ** bands <= 1e-5 and bands * rows <= 168
