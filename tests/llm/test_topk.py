"""Exact top-k by sorted lists against plain Python."""

import math
import random

import numpy as np
import pytest

from siftwell.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, id string, x int, block int"


def plain(rows, k=5):
    """Sorted (query, rank, id, score) by scoring every pair."""
    good = [(i, tuple(math.floor(256 * float(c)) for c in e)) for i, e in rows if i is not None and e is not None and all(c is not None and math.isfinite(c) for c in e)]
    out = []
    for q, x in sorted(set((i, e) for i, e in good if i % 50 == 0)):
        scored = sorted((-max(-topk.LONG, min(topk.LONG, sum(a * b for a, b in zip(x, y)))), i) for i, y in good if i != q and len(y) == len(x))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def found(spark, rows, **kw):
    df = spark.createDataFrame([(i, e, 0, "clash", 1, 2) for i, e in rows], SCHEMA)
    got = topk.top_k(df, **kw)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in got.collect())


def floats(*values):
    return [float(np.float32(v)) for v in values]


@pytest.mark.parametrize("reading", [topk.Reading(), topk.Reading(640, 3, 0.2, 1, 2), topk.Reading(16_000, 64, 0.005, 5)])
def test_random(spark, reading):
    """Clusters, one vector that a third of the rows share, ties, several blocks."""
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((6, 16))
    rows = []
    for i in range(400):
        v = centre[i % 6] + 0.4 * rng.standard_normal(16)
        rows.append((i, floats(*(v / np.linalg.norm(v)))))
    rows += [(1000 + i, rows[3][1]) for i in range(200)]
    random.Random(1).shuffle(rows)
    assert found(spark, rows, reading=reading) == plain(rows)


def test_edges(spark):
    """Nulls, numbers that are not finite, other lengths, no components, zeros, repeated rows and ids, fewer rows than k."""
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (50, [0.0, 0.0]), (1, [1.0, None]), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, None), (None, [1.0, 1.0]), (5, [-1.0, 0.5]),
        (6, [1.0, 2.0]), (6, [1.0, 2.0]), (7, [1.0, 2.0, 3.0]), (100, []), (8, []), (150, [0.25, -3.0]), (150, [0.25, -3.0]), (200, [1.0]), (-50, [0.001, -0.001]),
    ]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == []
    assert found(spark, [(50, [1.0])]) == []
    two = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [3.0, 4.0]), (2, [4.0, 3.0])]  # one id, two vectors: each asks
    assert found(spark, two) == plain(two)


def test_large_numbers(spark):
    """Sums beyond what doubles hold exactly, and beyond a long."""
    rng = np.random.default_rng(7)
    rows = [(i, floats(*(rng.standard_normal(8) * 3e6))) for i in range(120)]
    assert found(spark, rows, reading=topk.Reading(step=0.15, resolve=1)) == plain(rows)
    rows = [(0, [1e8, 1e8]), (1, [1e9, 1e8]), (2, [-1e9, 1.0]), (3, [1e10, 1e10])]
    assert found(spark, rows) == plain(rows)


def test_stops_early():
    """Where a few rows stand out, reading ends after a part of the lists; where none does, they are read to their end. Both are exact."""
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.standard_normal((5000, 32)) / 6).astype(np.int64)
    x[:10] = 4 * x[0] + np.floor(9 * rng.standard_normal((10, 32))).astype(np.int64)
    ids = np.arange(5000)
    for reading in (topk.Reading(), topk.Reading(step=0.02, resolve=10)):
        lists = topk.Lists(ids, x)
        for asked, early in ([0, 3], True), ([0, 77], False):
            found = lists.best(np.array(asked), x[asked], 5, reading)
            assert not early or lists.mark.sum() < lists.mark.size / 2
            for q, (got, score) in zip(asked, found):
                full = x @ x[q]
                want = sorted((i for i in range(5000) if i != q), key=lambda i: (-full[i], i))[:5]
                assert got.tolist() == want and score == full[want].tolist()
