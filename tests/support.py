"""Shared by the tests: where the tables are, and comparison with another engine."""

from __future__ import annotations

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    """A value in a form that compares equal across engines."""
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def same_rows(frame, con, sql):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(frame.columns)
    order = sorted(names)
    expected = sorted(repr([plain(dict(zip(names, r))[c]) for c in order]) for r in cursor.fetchall())
    found = sorted(repr([plain(r[c]) for c in order]) for r in frame.collect())
    assert found == expected
