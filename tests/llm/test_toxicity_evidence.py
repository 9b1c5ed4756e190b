"""Toxicity: evidence of several windows, long labelled texts, insults with gaps and insertions, and the tables' own held-out rows."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from support import DATA

from penumbra.llm import queries, toxicity
from test_models import _sentences

LARGE = DATA.replace("0.001", "0.1")


@pytest.fixture(scope="module")
def trained(spark):
    return toxicity.fit(spark.read.parquet(f"{LARGE}/documents.parquet"), spark.read.parquet(f"{LARGE}/labels.parquet"))


def _share(model, texts):
    return float((toxicity.probabilities(model, pa.array(texts, pa.string())) >= 0.5).mean())


def test_peaks_are_apart_and_windows_counted():
    texts, labels = _sentences(1, 300)
    model = toxicity.train(texts, labels, (200, 100))
    long = " ".join(texts[1:3])
    one, three = long + " dimwit. " + long, f"dimwit. {long} dimwit. {long} dimwit."
    (a, b, c, n), (d, e, f, m) = model.evidence(*toxicity.coded(pa.array([one, three])))
    assert a > b + 1 and f > b + 1 and abs(d - a) < 1 and m > n > 300
    assert np.isclose(model.evidence(*toxicity.coded(pa.array(["", "a"])))[:, :3], model.bias, atol=2).all()
    assert toxicity.probabilities(model, pa.array([three]))[0] >= toxicity.probabilities(model, pa.array([one]))[0]


def test_a_long_labelled_text_shuts_nothing_out(spark):
    texts, labels = _sentences(3, 300)
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(1000 + i, "plain words of no harm. " * 350_000, "x") for i in range(4)]
    marks = [(i, y) for i, y in enumerate(labels)] + [(1000 + i, i % 2) for i in range(4)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, toxic string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.fit(docs, known)
    found = toxicity.probabilities(model, pa.array(["you dimwit", "a nice day of rest"]))
    assert model.slope > 0.1 and found[0] >= 0.7 > found[1]


def test_repeated_ids_train_the_same_model(spark):
    texts, labels = _sentences(4, 90)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, "zz other"), (3, "aa other"), (None, "x")], "doc_id long, text string")
    known = spark.createDataFrame([*enumerate(labels), (None, 1), (5, None)], "doc_id long, toxic int")
    one, two = (toxicity.fit(d, known) for d in (docs, docs.repartition(7)))
    assert one.slope == two.slope and (one.weights == two.weights).all()


WORDS = ["trash", "pathetic", "idiot", "disgusting", "worthless", "stupid", "clown", "loser", "scum", "moron"]


def test_insults_with_gaps_and_insertions(trained):
    """Shares found of ten insults in a short sentence: plain, with a letter pushed in at every place, spelled with signs, and stretched."""
    say = lambda w: f"you are a {w} and you know it"
    assert _share(trained, [say(w) for w in WORDS]) == 1.0
    pushed = [say(w[:i] + "x" + w[i:]) for w in WORDS for i in range(1, len(w))]
    assert _share(trained, pushed) >= 0.6
    assert _share(trained, [say(s.join(w)) for w in WORDS for s in ".-* "]) >= 0.8
    assert _share(trained, [say(w[:i] + w[i] + w[i:]) for w in WORDS for i in range(len(w))]) >= 0.7
    assert _share(trained, [say(w.upper()) for w in WORDS]) == 1.0


def test_held_out_rows_of_the_large_table(spark, trained):
    """Above what lists of word starts reach (104 of 144 found, 6 false alarms among 1,200)."""
    docs = spark.read.parquet(f"{LARGE}/documents.parquet")
    rows = queries.op5_toxicity(spark, LARGE).where("held_out").join(spark.read.parquet(f"{LARGE}/labels.parquet"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    toxic, found = (Counter(r.lang for r in rows if r.toxic == 1 and p(r)) for p in (lambda r: True, lambda r: r.predicted == 1))
    assert sum(found.values()) >= 0.85 * sum(toxic.values())
    assert sum(r.predicted == 1 and r.toxic == 0 for r in rows) <= 6
    assert all(found[lang] >= 0.7 * n for lang, n in toxic.items())
