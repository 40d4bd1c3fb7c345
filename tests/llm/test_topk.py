from __future__ import annotations

import math
import random

import numpy as np
import pytest
from graphloom.llm import topk


def brute(rows, every, k):
    ok = [(i, n, [math.floor(256 * x) for x in v]) for i, (n, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, n, q in ok:
        if n is not None and n % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), m is None, m or 0) for j, m, v in ok if j != i)[:k]
            out += [(n, r, None if none else m, -s) for r, (s, none, m) in enumerate(scored, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed, monkeypatch):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(12)]) for i in range(300)]
    hot = [0.5] * 12
    rows += [(i, hot) for i in range(300, 420)] + [(50, rows[50][1]), (-50, [0.0] * 12), (700, None), (750, [0.1, None]), (800, [float("nan")]), (850, [float("inf")]), (None, hot), (900, []), (950, [1e6, -1e6] if seed == 3 else [3.0, 1.0])]
    if seed == 3:
        rows += [(1000, [20000.0, 1.0]), (1001, [150000.0, -7.0]), (1002, [3e9, 3e9, -2e3])]
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "FEW", 4)
    got = topk.search(spark.createDataFrame([(n, v, 1) for n, v in rows], "vec_id long, embedding array<double>, score int").repartition(3), every=50, k=5)
    assert sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()), key=str) == brute(rows, 50, 5)


def test_rounds(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROUND", 3)
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(40)]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=4, k=3)
    assert sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()), key=str) == brute(rows, 4, 3)


def test_few_and_none(spark):
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    got = topk.search(spark.createDataFrame([(0, [1.0]), (1, [1.0])], "vec_id long, embedding array<float>")).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 65536)]


def test_components_of_any_size(spark):
    rows = [(50, [20000.0, 1.0]), (1, [1e6, 5.0]), (2, [30000.0, 3.0]), (3, [2.0, 1.0]), (100, [1e9, -1e9]), (4, [1e9, 1e9]), (5, [1e9, 1e9 + 1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="OverflowError"):
        topk.search(frame, every=50, k=5).collect()
    got = topk.search(frame.where("vec_id < 4 OR vec_id = 50"), every=50, k=5)
    assert sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()), key=str) == brute(rows[:4], 50, 5)
    small = [(0, [1e-3, 1e9]), (1, [1e9, 1.0]), (2, [5.0, -1e9]), (3, [1e9, -3.0])]
    got = topk.search(spark.createDataFrame(small, "vec_id long, embedding array<double>"), every=50, k=2)
    assert sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()), key=str) == brute(small, 50, 2)


def test_bound_never_loses_a_member():
    rng = np.random.default_rng(4)
    for scale in (90, 3000):
        x = (rng.standard_normal((600, 32)) * scale).round()
        x[:40] *= 5
        q = (rng.standard_normal((20, 32)) * scale).round()
        impacts, left = topk.quantised(x)
        parts, again = topk.segments({"impacts": impacts.astype(np.float32).tobytes(), "left": left.tobytes(), "whole": True, "width": 32}, 600)
        assert np.allclose(sum(parts), np.where(np.abs(impacts) > 0, impacts, 0)) and (again == left).all()
        for k in range(len(topk.SEGMENTS) + 1):
            assert np.allclose(left[k], np.linalg.norm(x - sum(parts[:k], np.zeros(x.shape)), axis=1))
        a, b = topk.possible(q, parts, left, 5, np.full(20, -np.inf))
        alive = set(zip(a.tolist(), b.tolist(), strict=True))
        exact = q.astype(int) @ x.astype(int).T
        assert len(alive) < 20 * 60
        for i in range(20):
            assert all((i, j) in alive for j in np.argsort(-exact[i])[:5])
        assert len(topk.possible(q, parts, left, 5, np.full(20, 1e15))[0]) == 0
