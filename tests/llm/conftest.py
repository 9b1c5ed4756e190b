from __future__ import annotations

import pytest

LONG = "wörd " * 20_000 + "x" * 30_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, key long, row_number int"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and very long texts, copies, repeated rows, and columns whose names clash with the operators' own."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again", "en", "a", 1, "x", 1, 1),
        (2, "the quick brown fox jumps over the lazy dog again", None, None, None, None, None, None),
        (2, "the quick brown fox jumps over the lazy dog again", None, None, None, None, None, None),
        (3, "", "en", "a", 0, "x", 1, 1),
        (4, None, "en", "a", 0, "x", 1, 1),
        (5, "one", "en", "a", 3, "x", 1, 1),
        (6, LONG, "en", "a", 9, "x", 1, 1),
        (7, "  spaces\t\n and  \r\n tabs   ", "en", "a", 9, "x", 1, 1),
        (None, "no id", "en", "a", 9, "x", 1, 1),
        (8, "THE QUICK brown fox jumps over the lazy dog again", "en", "a", 9, "x", 1, 1),
        (9, "mail me: a.b@c.example.com or a [at] d [dot] org", "en", "a", 9, "x", 1, 1),
        (10, "日本語 😀 café", "en", "a", 9, "x", 1, 1),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
