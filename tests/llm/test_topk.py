"""Top-k inner products against Python integers: large components, repeated ids, ties, few rows and mixed lengths."""

import math
from fractions import Fraction

import numpy as np
import pytest

from weftgraph.llm import topk


def brute(rows, every=50, k=5):
    whole = [(n, i, [math.floor(256 * Fraction(x)) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, v in whole:
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for m, j, w in whole if m != n and len(v) == len(w))[:k]
            out += [(i, r + 1, j, -s if abs(s) < 1 << 63 else None) for r, (s, j) in enumerate(scores)]
    return sorted(out, key=str)


def found(spark, rows, **more):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, id string, row int")
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_inner_products(df, **more).collect()), key=str)


@pytest.mark.parametrize("pilot", [1, 4])
def test_against_integers(spark, monkeypatch, pilot):
    monkeypatch.setattr(topk, "ROWS", 16)
    monkeypatch.setattr(topk, "QUERIES", 3)
    monkeypatch.setattr(topk, "PILOT", pilot)
    rng = np.random.default_rng(pilot)
    rows = [(i, rng.normal(size=7).tolist()) for i in range(150)] + [(50, rng.normal(size=7).tolist()), (50, rng.normal(size=7).tolist()), (None, [1.0] * 7), (400, None), (450, [1.0, None] + [0.0] * 5), (500, [math.inf] * 7)]
    rows += [(200 + i, [0.5] * 7) for i in range(12)] + [(1000 + i, [float(i), 1.0]) for i in range(4)] + [(2000, []), (2001, [])]
    assert found(spark, rows) == brute(rows)


def test_large_components(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 8)
    rng = np.random.default_rng(9)
    scales = [1.0, 3e8, 1e17, 1e200, -1e200, 1.7e308, 1e-300, 2.0**44, 2.0**52 + 2]
    rows = [(i, (rng.normal(size=2) * scales[i % 9]).tolist()) for i in range(0, 200, 5)] + [(50, [1e200, 1.0]), (100, [3e8, 1.0]), (7, [1.7e308, -1.7e308]), (8, [2.0**31, 2.0**31 + 1 / 256])]
    rows = [(i, [x if math.isfinite(x) else 1.7e308 for x in v]) for i, v in rows]
    assert found(spark, rows) == brute(rows)


def test_keys_are_in_order():
    values = [0, 1, -1, 255, 256, -255, -256, 1 << 63, -(1 << 63), 10**600, -(10**600), (1 << 64) - 1]
    assert sorted(values) == sorted(values, key=topk.order_key) and [topk.of_key(topk.order_key(x)) for x in values] == values


def test_few_rows(spark):
    assert found(spark, [(50, [1.0])]) == [] and found(spark, [(50, [1.0]), (51, [2.0])]) == [(50, 1, 51, 256 * 512)]
