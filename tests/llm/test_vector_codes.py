"""Codes of vectors against Python integers: ties, few, large, short and useless vectors."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from weftgraph.llm import vector_codes


def brute(rows):
    kept = [(i, label, [math.floor(256 * Fraction(x)) for x in v], v) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = -(-max(len(v) for *_, v in kept) // 16)
    parts = [[(v + [0] * (16 * width - len(v)))[k * width : (k + 1) * width] for k in range(16)] for _, _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][3]))[:64]
    books = [[parts[r][k] for r in order] for k in range(16)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda p, book: min((away(p, e), j) for j, e in enumerate(book))
    for _ in range(2):
        for k, book in enumerate(books):
            at = [nearest(p[k], book)[1] for p in parts]
            books[k] = [[sum(parts[r][k][d] for r in of) // len(of) for d in range(width)] if (of := [r for r, j in enumerate(at) if j == e]) else book[e] for e in range(len(book))]
    best = [[nearest(p[k], books[k]) for k in range(16)] for p in parts]
    errors = [sum(d for d, _ in b) for b in best]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    fits = lambda x: x if x is not None and x < 1 << 63 else None
    out = []
    for (i, label, _, _), b, e in zip(kept, best, errors, strict=True):
        same = [x for x, row in zip(errors, kept, strict=True) if row[1] == label]
        total = None if any(fits(x) is None for x in same) else fits(sum(same))
        out.append((i, "".join(f"{j:02x}" for _, j in b), fits(e), total, digest))
    return sorted(out, key=str)


def found(spark, rows):
    df = spark.createDataFrame([(i, v, label, "x") for i, v, label in rows], "vec_id long, embedding array<double>, label int, code string")
    return sorted((tuple(r) for r in vector_codes.compressed(df).collect()), key=str)


@pytest.mark.parametrize("length", [16, 40, 64])
def test_against_integers(spark, length):
    rng = random.Random(length)
    rows = [(rng.randrange(500), [rng.choice([rng.gauss(0, 0.2), 0.125]) for _ in range(length)], rng.choice([1, 2, None])) for _ in range(200)]
    rows += [(3, rows[0][1], 1)] * 3 + [(None, rows[1][1], 2), (5, None, 1), (6, [1.0, None], 1), (7, [math.inf] * length, 2), (8, [math.nan] * length, None), (9, [], 1), (10, [0.5] * (length - 3), 2)]
    assert found(spark, rows) == brute(rows)


def test_few_and_large(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [], None)]) == brute([(1, [], None)])
    rng = random.Random(1)
    few = [(i, [rng.gauss(0, 1) for _ in range(17)], i % 2) for i in range(5)]
    assert found(spark, few) == brute(few)
    large = [(i, [rng.choice([1e30, -1e18, 1e9, 2.0**52 + 1, 0.3, 1.7e308]) for _ in range(16)], i % 3) for i in range(90)] + [(200 + i, [rng.gauss(0, 2e5) for _ in range(16)], 7) for i in range(20)]
    assert found(spark, large) == brute(large)


def test_bounds_keep_the_nearest():
    rng = np.random.default_rng(2)
    entries = rng.integers(-200, 200, (64, 4))
    file = vector_codes.CellFile(entries)
    parts = np.concatenate([rng.integers(-300, 300, (5000, 4)), entries])
    away = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
    index, distance = file.nearest(parts)
    assert (index == away.argmin(axis=1)).all() and (distance == away.min(axis=1)).all()
    i, _ = file.candidates(parts)
    assert len(i) < len(parts) * 64 / 3  # the bounds leave most entries out


def test_decode(spark):
    rows = spark.createDataFrame([(i, [i / 7.0] * 32) for i in range(80)], "id long, v array<double>")
    books = vector_codes.learned(rows)
    assert books.decode("00" * 16) == [x for b in books.entries for x in b[0].tolist()] and len(books.decode("3f" * 16)) == 32
