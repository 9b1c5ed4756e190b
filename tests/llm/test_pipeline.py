"""The pipeline's stages: columns, decisions, and their effects on planted rows."""

from __future__ import annotations

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
from support import DATA
from test_dedup import brute_components
from tokenizers import Tokenizer

from penumbra.llm import exact_dedup, near_dedup, personal_data, toxicity


def test_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "pii", "packing"]


def test_run_against_brute_force(spark):
    """All stages by plain definitions: dictionaries, all pairs, the library's ids; the trained model is asked text by text."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    texts = {i: t for i, t in texts.items() if toxicity.probabilities(model, pa.array([t]))[0] < 0.7}
    last = {t: max(i for i, x in texts.items() if x == t) for t in texts.values()}
    texts = {i: texts[i] for i in last.values()}
    component = brute_components(list(texts.items()), 5, 80)
    texts = {i: personal_data.redact_text(t) for i, t in texts.items() if component[i][1] == i}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes() for i, t in texts.items()}
    got, sequences = {}, {}
    for r in sorted(corpus_pipeline.run(spark, DATA).collect(), key=lambda r: (r.doc_id, r.piece)):
        got[r.doc_id] = got.get(r.doc_id, b"") + bytes(r.ids)
        sequences[r.sequence_id] = sequences.get(r.sequence_id, 0) + r.length
    assert got == expected
    assert max(sequences.values()) <= 2048


def test_stages_keep_clashing_columns_and_empty_tables(spark):
    names = "row", "sha", "keep", "group_text", "text_sha256", "keep_id", "component_id", "kept", "print", "label", "row_"
    schema = "doc_id long, text string, " + ", ".join(f"{n} int" for n in names)
    rows = [(i, t, *[k] * len(names)) for k, (i, t) in enumerate([(1, "one two"), (2, "one two"), (None, None), (3, "x@y.example"), (3, "other")])]
    docs, nothing = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and out.count() in (4, 5)
        assert stage(spark, nothing, DATA).count() == 0
    assert corpus_pipeline.pack(spark, nothing, DATA).count() == 0 and corpus_pipeline.pack(spark, docs, DATA).count() == 5


def test_each_stage_on_planted_rows(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    near = base + " " + " ".join(f"w{i}" for i in range(40))
    rows = [
        (1, near, "en", "s", None),
        (2, near, "en", "s", 1),
        (3, near + " extra", "en", None, 1),
        (4, "my mail is a@b.example.com", "en", "s", 1),
        (5, None, None, None, None),
        (6, "", "en", "s", 0),
        (7, "something else entirely", "en", "s", 3),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    exact = corpus_pipeline.drop_copies(spark, docs, DATA)
    assert exact.columns == docs.columns
    assert sorted(r.doc_id for r in exact.collect()) == [2, 3, 4, 6, 7]
    apart = corpus_pipeline.drop_near_copies(spark, exact, DATA)
    assert sorted(r.doc_id for r in apart.collect()) == [2, 4, 6, 7]
    clean = {r.doc_id: r for r in corpus_pipeline.redact_personal_data(spark, apart, DATA).collect()}
    assert clean[4].text == "my mail is <EMAIL>" and clean[4].n_chars == 18 and clean[7].text == rows[6][1]
    toxic = corpus_pipeline.drop_toxic(spark, docs, DATA)
    assert toxic.columns == docs.columns and toxic.count() == 7


def test_kept_rows_match_the_operators(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {r.doc_id for r in exact_dedup.exact_duplicates(docs).where("kept").collect()}
    assert {r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, DATA).collect()} == kept
    kept = {r.doc_id for r in near_dedup.near_duplicates(docs, width=5, percent=80).where("kept").collect()}
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, DATA).collect()} == kept
    texts = {r.doc_id: personal_data.redact_text(r.text) for r in docs.collect()}
    assert {r.doc_id: r.text for r in corpus_pipeline.redact_personal_data(spark, docs, DATA).collect()} == texts


def test_decisions_take_effect_on_rows_without_or_with_repeated_ids(spark, monkeypatch):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame = lambda rows: spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], schema).repartition(2)
    held = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)

    clean = [f"a quiet sentence of number {i} is here" for i in range(40)]
    model = toxicity.train(clean + [f"{t} dimwit" for t in clean], [0] * 40 + [1] * 40, (40, 40))
    monkeypatch.setattr(toxicity, "fit", lambda *_: model)
    rows = [(None, clean[0]), (None, clean[1] + " dimwit"), (1, clean[2]), (1, clean[3] + " dimwit"), (2, None)]
    assert held(corpus_pipeline.drop_toxic(spark, frame(rows), DATA)) == sorted([rows[0], rows[2], rows[4]], key=repr)

    rows = [(None, "same"), (None, "same"), (None, "mine"), (None, "mine"), (7, "same"), (7, "same"), (7, "other"), (9, "other"), (9, None), (3, "")]
    assert held(corpus_pipeline.drop_copies(spark, frame(rows), DATA)) == sorted([(7, "same"), (None, "mine"), (9, "other"), (9, None)], key=repr)

    one, two = (" ".join(f"{p}{i}" for i in range(60)) for p in "ab")
    rows = [(None, one), (None, one + " more"), (5, two), (6, "x"), (6, two + " more"), (6, one + " other"), (None, ""), (None, "  "), (8, "free")]
    expected = [(5, two), (6, "x"), (6, one + " other"), (None, ""), (None, "  "), (8, "free")]
    assert held(corpus_pipeline.drop_near_copies(spark, frame(rows), DATA)) == sorted(expected, key=repr)
