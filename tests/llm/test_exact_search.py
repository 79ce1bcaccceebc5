import math
import random

import numpy as np
import pytest

from crossmer.llm import exact_search

VECTORS = "vec_id long, embedding array<double>, label int, block long, ids string, size string, cell string, score string"


def brute(rows, k=5):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
              if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, v) in enumerate(usable):
        if i is not None and i % 50 == 0:
            scored = sorted(((-max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), j is None, j or 0, j)
                             for m, (j, w) in enumerate(usable) if m != n), key=lambda s: s[:3])
            out += [(i, rank, s[3], -s[0]) for rank, s in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def found(spark, rows):
    frame = spark.createDataFrame([(i, v, 0, 1, "x", "y", "z", "s") for i, v in rows], VECTORS).repartition(3)
    return sorted(map(tuple, exact_search.top_k(frame).collect()), key=str)


def vectors(seed, n, width, spread=0.2):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    return [(i, [c + rng.gauss(0, spread) for c in rng.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize("width,spread", [(1, 0.2), (7, 0.01), (64, 0.2), (130, 3.0)])
def test_against_brute_force(spark, monkeypatch, width, spread):
    monkeypatch.setattr(exact_search, "BLOCK_ROWS", 37)
    rows = vectors(width, 420, width, spread)
    rows += [(i, v) for i, v in rows[:60]] + [(None, rows[3][1]), (1000, rows[3][1])]      # equal ids, equal vectors
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.1, 0.2]), (0, [0.1, 0.2]), (50, []), (100, None), (150, [None, 0.3]), (200, [nan, 1.0]), (250, [inf]),
            (None, [0.5, -0.5]), (None, None), (-50, [-0.001, 0.0, 3.0]), (7, [1e3, -1e3]), (8, [0.0])]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0])]) == []


def test_values_beyond_every_exact_type(spark):
    rows = [(i, [x, -x / 3, 1.0, 5.0 / (i + 1)]) for i, x in enumerate([1e3, 1e6, 1e9, 1e17, 3e18, -2e9, 1.0] * 9)]
    assert found(spark, rows) == brute(rows)


def test_bounds_leave_out_most_candidates():
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 100, (40, 64))
    columns = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(0, 5, (4000, 64))).T
    queries = np.floor(centres[rng.integers(0, 40, 50)])
    q, c, score = exact_search.survivors(queries, columns, np.full(50, -1), np.full(50, -np.inf), 5)
    whole = queries @ columns
    assert len(q) < 0.1 * whole.size
    assert (score == whole[q, c]).all()
    for i in range(50):
        assert sorted(score[q == i])[-5:] == sorted(whole[i])[-5:]
