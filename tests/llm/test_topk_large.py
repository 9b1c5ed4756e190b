"""Top-k search over components whose products doubles don't hold, and beyond what a long holds."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from penumbra.llm import topk


def test_products_beyond_doubles_are_exact():
    rng = np.random.default_rng(6)
    v = rng.integers(-(1 << 27), 1 << 27, (1500, 8)) * 3 + 1
    v[700:760] = v[3]
    v[760:800] = v[3]
    v[760:800, 0] += np.arange(40)  # scores that doubles can't tell apart
    tree = topk.MTree(np.arange(1500), v, int((v.astype(object) ** 2).sum(1).max()))
    assert tree.whole is not None
    for q in [3, 720, *range(0, 1500, 211)]:
        scores = [int(sum(int(a) * int(b) for a, b in zip(v[i], v[q], strict=True))) for i in range(1500)]
        order = sorted((i for i in range(1500) if i != q), key=lambda i: (-scores[i], i))[:20]
        found = sorted(tree.search(v[q], 20, q), key=lambda x: (-x[0], x[1]))
        assert [i for _, i in found] == order and [s for s, _ in found] == [scores[i] for i in order]


def test_what_no_long_holds_is_refused(spark):
    for x in ([1e18, 1.0], [4e6, 4e6]):
        frame = spark.createDataFrame([(0, x), (1, [1.0, 2.0])], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="long"):
            topk.top_k(frame, F.col("vec_id") == 0).collect()
    frame = spark.createDataFrame([(0, [2e5, 1.0]), (1, [1.0, 2e5]), (2, [3e5, 5.0])], "vec_id long, embedding array<double>")
    k = 1024 * 1024
    got = [(r.rank, r.vec_id, r.score) for r in topk.top_k(frame, F.col("vec_id") == 0).collect()]
    assert got == [(1, 2, (2 * 3 * 10**10 + 5) * k), (2, 1, 4 * 10**5 * k)]
