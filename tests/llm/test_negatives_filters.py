"""Hard negatives, the filter audit and URL filters against brute force and on odd rows."""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F
from support import DATA, same_rows

from penumbra.llm import filter_audit, hard_negatives, queries, url_filters

VECTORS = "vec_id long, embedding array<float>, label int, score string, row int, d string"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_filter_audit", "op13_url_filters"])
def test_queries_match_sql(spark, duck, name):
    same_rows(queries.QUERIES[name](spark, DATA), duck, queries.ORACLE_SQL[name])


# --- hard negatives


def mined_by_hand(rows, every, positives, negatives, scale=256):
    """``(anchor, positive, rank, negative, positive score, negative score)`` by all products; rows are (id, vector, label)."""
    kept = []
    for n, (i, x, label) in enumerate(rows):
        if i is not None and label is not None and x and all(c is not None and math.isfinite(c) for c in x):
            kept.append((n, i, [math.floor(scale * float(np.float32(c))) for c in x], label))
    out = []
    for n, i, x, label in kept:
        if i % every:
            continue
        others = [(-sum(a * b for a, b in zip(x, y, strict=True)), j, m, other) for m, j, y, other in kept if m != n and len(y) == len(x)]
        for s, j, _, _ in sorted(o for o in others if o[3] == label)[:positives]:
            found = sorted(o for o in others if o[3] != label and 50 * -s <= 100 * -o[0] <= 95 * -s)[:negatives]
            out += [(i, j, rank, k, -s, -t) for rank, (t, k, _, _) in enumerate(found, 1)]
    return sorted(out)


def mined(frame, every, **more):
    found = hard_negatives.hard_negatives(frame, F.col("vec_id") % every == 0, **more).drop("positive_rank").collect()
    return sorted(tuple(r) for r in found)


def test_hard_negatives_match_brute_force_in_blocks(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 9))
    rows = [(i, (centres[i % 6] + rng.normal(size=9) * 0.7).tolist(), int(rng.integers(4))) for i in range(400)]
    rows += [(i, rows[7][1], i % 3) for i in range(400, 460)]  # one common vector: ties everywhere
    rows += [(i, rng.normal(size=4).tolist(), i % 2) for i in range(460, 480)]  # another length
    frame = spark.createDataFrame([(*r, "s", 1, "d") for r in rows], VECTORS).repartition(3)
    expected = mined_by_hand(rows, 10, 5, 3)
    assert len(expected) > 300
    assert mined(frame, 10, block_rows=60, block_anchors=9, share_blocks=2) == expected
    assert mined(frame, 10, positives=5, negatives=3) == expected


def test_hard_negatives_of_odd_rows(spark):
    one = [1.0, 0.5]
    rows = [
        (0, one, 1), (1, one, 1), (2, [0.8, 0.4], 2), (3, None, 1), (4, [None, 1.0], 1), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 2),
        (7, [], 1), (8, [0.8, 0.4], None), (None, one, 1), (0, one, 1), (2, [0.8, 0.4], 2), (10, [-1.0, -1.0], 3), (11, [-1.0, -2.0], 3),
        (20, [1.0, 2.0, 3.0], 1), (21, [0.0, 0.0], 4), (30, [0.0, 0.0], 4),
    ]
    frame = spark.createDataFrame([(*r, None, None, None) for r in rows], VECTORS)
    assert mined(frame, 10) == mined_by_hand(rows, 10, 5, 3)
    assert mined(frame.limit(0), 10) == []
    with pytest.raises(Exception, match="long"):
        mined(spark.createDataFrame([(0, [1e30, 1.0], 1, "", 1, "")], VECTORS), 10)
    with pytest.raises(Exception, match="long"):
        mined(spark.createDataFrame([(0, [3e6, 1.0], 1, "", 1, "")], VECTORS), 10)


def test_bounds_hold_for_any_codebook():
    rng = np.random.default_rng(1)
    vectors, anchors = rng.integers(-900, 900, (500, 7)), rng.integers(-900, 900, (20, 7))
    for books in (hard_negatives.fit_books(vectors), hard_negatives.fit_books(vectors[:3]), [np.zeros((1, n)) for n in (2, 2, 2, 1)]):
        codes, left = hard_negatives.encode(vectors, books)
        block = hard_negatives.Block(
            {"ids": 0, "rows": 0, "labels": 0, "codes": codes, "left": left, "vectors": vectors, "books": np.frombuffer(hard_negatives.pickle.dumps(books), np.uint8),
             "longest": np.sqrt((vectors**2).sum(1)).max()}
        )
        block.ids = np.arange(500)
        low, high = block.bounds(anchors)
        exact = anchors @ vectors.T
        assert (low <= exact).all() and (exact <= high).all()
    codes, left = hard_negatives.encode(vectors, hard_negatives.fit_books(vectors))
    assert np.median(left) < 0.15 * np.median(np.sqrt((vectors**2).sum(1)))  # the fit is worth having


# --- filter audit


def audited_by_hand(docs, labels):
    """Filters applied one after another to the rows themselves, for every order."""
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    rows = []
    for i, text, part in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = "".join(
            f
            for f, fail in zip(
                "ABCDE",
                [
                    len(words) < 50,
                    100 * len(set(words)) < 65 * len(words),
                    100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
                    bool(re.search(r"[#$%&*|]", text)),
                    i is not None and i > least[text],
                ],
                strict=True,
            )
            if fail
        )
        rows.append((part or "", fails, i in good, i in toxic))
    out, shares = {}, Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                removed, after = [r for r in left if f in r[1]], [r for r in left if f not in r[1]]
                shares[part, f] += len(removed)
                out[part, order, step] = [
                    f, len(after), len(removed), sum(f in r[1] for r in own) - len(removed), sum(r[1] == f for r in own), sum(r[2] for r in removed), sum(r[3] for r in removed)
                ]
                left = after
    return {k: (*v, shares[k[0], v[0]]) for k, v in out.items()}


def test_filter_audit_matches_brute_force_on_odd_rows(spark, odd_documents):
    many = " ".join(f"w{i}" for i in range(60))
    extra = [
        (20, many, None, "b", 1, "", 1, 1), (21, many, None, "b", 1, "", 1, 1), (22, many + " #", None, None, 1, "", 1, 1), (23, "SHOUT " * 60, None, "", 1, "", 1, 1),
        (24, many, None, None, 1, "", 1, 1), (None, many, None, "b", 1, "", 1, 1), (21, many, None, "c", 1, "", 1, 1), (25, "\u00a0".join("ab\u3000cd"), None, "b", 1, "", 1, 1),
        (26, "x\x0by\x0cz " * 30, None, "b", 1, "", 1, 1), (27, "a\x1cb " * 60, None, "b", 1, "", 1, 1),
    ]
    docs = odd_documents.union(spark.createDataFrame(extra, odd_documents.schema)).repartition(4)
    labels = [(20, 1, 1), (21, 1, 0), (1, 0, 1), (2, 1, 1), (2, 0, None), (None, 1, 1), (99, 1, 1), (23, None, 1)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    plain = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    fields = ["filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = {(r.part, r.filter_order, r.step): tuple(r[f] for f in fields) for r in filter_audit.filter_audit(docs, frame).collect()}
    assert found == audited_by_hand(plain, labels)


def test_filter_audit_of_empty_tables(spark, no_documents):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(no_documents, labels).count() == 0
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    rows = filter_audit.filter_audit(one, labels).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""} and {r.shapley for r in rows} == {120, 0}


# --- URL filters

URLS = [
    "http://a.net/x", "http://net/x", "http://net", "http://bnet/x", "https://www.Example.NET/en/1?x=/de/", "https://example.net/EN/1", "http://example.com/de/", "http://xexample.com/de/1",
    "http://x.example.com/de", "http://y.org/fr/a#b", "http://y.org/en/casino/1", "http://my-casino.example.org/", "http://casinoroyale.org/", "http://free-bets.example.org/x",
    "http://o.org/Porno/1", "http://o.org/porn", "http://o.org/?casino", "mailto:x", "", None, "://", "http://", "http:///net/", "http://u@a.net:80/", "http://a.net?x", "http://a.net#x",
    "a://b://c.net/", "http://ünï.net/ß", "http://o.org/a\nb/xxx/", "http://" + "a" * 5000 + ".net/" + "casino/" * 2000, "http://o.org/adult-x", "http://o.org/spamfarm",
]


def judged_by_hand(url, host_rules, word_rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    rest = re.split("[?#]", rest, maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    host = host.translate({c: c + 32 for c in range(65, 91)})
    path = slash + path
    fits = [r for r in host_rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    rule = max(fits, key=lambda r: len(r.name), default=None)
    words = [r.words for r in word_rules if re.search(f"(?i)(?:^|[^A-Za-z0-9]){r.words.replace('*', '[A-Za-z0-9]*')}(?:$|[^A-Za-z0-9])", host + path)]
    return host, path, rule and rule.name, rule.verdict if rule else "block" if words else "allow", min(words, default=None)


def test_url_filters_match_all_rules_tried(spark):
    rows = [(i, u, "html", "rule") for i, u in enumerate(URLS)] + [(None, URLS[0], "", ""), (3, URLS[0], "", ""), (3, URLS[3], "", ""), (3, URLS[3], "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, rule string").repartition(3)
    more = [*queries.HOST_RULES, url_filters.HostRule("allow", "a.net", "/x"), url_filters.HostRule("block", "example.org", "/")]
    for host_rules, word_rules in ((queries.HOST_RULES, url_filters.BLOCKED_WORDS), (more, [*url_filters.BLOCKED_WORDS, url_filters.WordRule("*farm"), url_filters.WordRule("a*")])):
        found = url_filters.judge(pages, host_rules, word_rules).collect()
        key = lambda r: tuple((v is not None, str(v)) for v in r)
        expected = [(i, *judged_by_hand(u, host_rules, word_rules)) for i, u, _, _ in rows]
        assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)
    assert url_filters.judge(pages.limit(0), queries.HOST_RULES).count() == 0


def test_rules_are_indexed_by_their_rarest_token(spark):
    addresses = spark.createDataFrame([(["net", "example", ""],), (["net", "en", "example", ""],), (["net", ""],)], "tokens array<string>")
    rules = [*queries.HOST_RULES, url_filters.WordRule("*x"), url_filters.WordRule("net-farm")]
    index = {r.rule: r.token for r in url_filters.rule_index(addresses, rules).collect()}
    assert index == {"net/": "net", "example.net/en/": "en", "example.com/de/": "com", "org/fr/": "fr", "*x": "", "net-farm": "farm"}


def test_more_rules_than_are_shipped_give_the_same(spark, monkeypatch):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    few = sorted(map(tuple, url_filters.judge(pages, queries.HOST_RULES).collect()), key=key)
    monkeypatch.setattr(url_filters, "SHIPPED_RULES", 0)
    assert sorted(map(tuple, url_filters.judge(pages, queries.HOST_RULES).collect()), key=key) == few
