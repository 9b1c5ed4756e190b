"""Personal data: texts that once ended the job, prose that isn't a disguise, and the registered query."""

from __future__ import annotations

import hashlib
import re

import pytest
from support import DATA

from penumbra.llm import personal_data, queries


@pytest.mark.parametrize("text", ["0" * 5000 + ".1.1.1", "1.1.1." + "9" * 6000, "1" * 20_000, "+" + "1 " * 9000, "1.2.3." + "0" * 4400 + "4 x"])
def test_long_runs_of_digits(text):
    base, _ = personal_data.all_spans(text)
    ips = [(a, b) for kind, a, b in base if kind == "ip"]
    expected = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]
    assert ips == expected
    personal_data.redact_text(text)


@pytest.mark.parametrize("text", ["he looked at example.com today", "look at site.org", "Meet me at shop.example.net.", "at work.today we met", "we are at the example.com stand"])
def test_prose_about_sites_is_left_alone(text):
    assert personal_data.redact_text(text) == text


@pytest.mark.parametrize(
    "text", ["john at example dot com", "john at example [dot] com", "john.smith at example.com", "john7 at mail.example.org", "j_s at example.com", "john at mail.example (dot) org", "john [at] example.com"]
)
def test_spoken_addresses_are_found_whole(text):
    assert personal_data.redact_text(f"mail {text} now") == "mail <EMAIL> now"


def test_registered_query_against_plain_patterns(spark):
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def luhn(d):
        return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    def good(kind, value):
        digits = re.sub("[^0-9]", "", value)
        return {
            "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in value.split(".")), "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
            "phone": lambda: 9 <= len(digits) <= 15,
        }[kind]()

    rows = {r.doc_id: r for r in queries.op9_pii(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for doc in docs:
        base = {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, doc.text or "") if good(k, m.group())] for k, p in kinds.items()}
        listed = [s for k in kinds for s in base[k]]
        row = rows[doc.doc_id]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [len(base[k]) for k in kinds]
        assert row.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        spans = row.spans.split(",") if row.spans else []
        assert set(listed) <= set(spans) and len(spans) == len(listed) + row.n_added
        order = [(list(kinds).index(k), int(a)) for k, a, _ in (s.split(":") for s in spans)]
        assert order == sorted(order)
