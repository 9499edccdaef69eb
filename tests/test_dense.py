"""Blocked nearest vectors and bounded fusion against plain programs."""

from __future__ import annotations

import numpy as np
import pytest

from gleaner.operators import dense as D


def vectors(spark, x, key, scale=None):
    rows = [(k, v, float(scale[k]) if scale is not None else 1.0) for k, v in enumerate(x.tolist())]
    return spark.createDataFrame(rows, f"{key} long, v array<double>, scale double")


def brute(q, x, k, qs=None, xs=None):
    score = np.round((q @ x.T) * (xs if xs is not None else 1.0) * (qs[:, None] if qs is not None else 1.0), D.DIGITS)
    return {(i, int(j), r + 1, score[i, j]) for i in range(len(q)) for r, j in enumerate(np.lexsort((np.arange(len(x)), -score[i]))[:k])}


@pytest.mark.parametrize("grid", [(2048, 1 << 18), (7, 50)])
def test_nearest_with_ties(spark, monkeypatch, grid):
    """Small whole numbers give many equal scores; blocks of any shape give the same rows."""
    monkeypatch.setattr(D, "QUERY_BLOCK", grid[0])
    monkeypatch.setattr(D, "ROW_BLOCK", grid[1])
    monkeypatch.setattr(D, "SCORES", 100)
    random = np.random.default_rng(0)
    x, q = random.integers(-2, 3, (700, 4)).astype(float), random.integers(-2, 3, (30, 4)).astype(float)
    xs, qs = random.choice([0.5, 1.0], 700), random.choice([0.25, 2.0], 30)
    found = D.nearest(vectors(spark, x, "passage_id", xs), vectors(spark, q, "question_id", qs), 9)
    got = {(r.question_id, r.passage_id, r.rank, r.score) for r in found.collect()}
    assert got == brute(q, x, 9, qs, xs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_nearest_of_few_rows(spark):
    x = np.eye(3)
    found = D.nearest(vectors(spark, x, "passage_id"), vectors(spark, x[:2], "question_id"), 5).collect()
    assert len(found) == 6 and {(r.question_id, r.passage_id) for r in found if r.rank == 1} == {(0, 0), (1, 1)}
    assert D.nearest(vectors(spark, x, "passage_id"), vectors(spark, x, "question_id").limit(0), 5).count() == 0
    assert D.nearest(vectors(spark, x, "passage_id").limit(0), vectors(spark, x, "question_id"), 5).count() == 0


@pytest.mark.parametrize("weight,spread", [(0.6, 0.01), (0.75, 1.0), (0.1, 1.0), (0.9, 0.0)])
def test_fusion_misses_nothing(spark, weight, spread):
    """Also where the best fused passages are neither among the best dense nor among the best lexical ones."""
    random = np.random.default_rng(int(100 * weight))
    x, q = random.normal(0, spread, (400, 5)) + 0.2, random.normal(0, 1, (12, 5))
    lexical = {(i, j): float(random.choice([1, 2, 3, 10]) * random.random()) for i in range(11) for j in random.choice(400, 250, replace=False).tolist()}
    frame = spark.createDataFrame([(i, j, s) for (i, j), s in lexical.items()], "question_id long, passage_id long, lexical double")
    for k in (3, 64):
        found = D.fused_top(vectors(spark, x, "passage_id"), vectors(spark, q, "question_id"), frame, k, weight).collect()
        for i in range(12):
            top = max((s for (a, _), s in lexical.items() if a == i), default=0)
            fused = [round(weight * float(q[i] @ x[j]) + (1 - weight) * (lexical.get((i, j), 0) / top if top else 0), D.DIGITS) for j in range(400)]
            want = sorted(range(400), key=lambda j: (-fused[j], j))[:k]
            got = sorted((r for r in found if r.question_id == i), key=lambda r: r.rank)
            assert np.allclose([r.score for r in got], [fused[j] for j in want], atol=1e-8)
            assert {r.passage_id for r in got} == set(want) or len(set(fused[j] for j in want)) < k
