"""The pipeline drops near copies of a similarity of 0.8 or more, below op1's 0.85."""

import math
import os
import random

import corpus_pipeline
import pytest
from weftgraph.llm import near_dedup

from test_pipeline import SCHEMA, shingles


def similarity(a, b):
    return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))


def test_near_copies_from_80_to_85(spark, tmp_path):
    rng = random.Random(8)
    texts = []
    for i in range(40):
        w = [f"d{i}w{rng.randrange(900)}" for _ in range(94)]
        v = list(w)
        v[20], v[60] = "x", "y"
        texts += [" ".join(w), " ".join(v)]
        w = [f"d{i}s{k}" for k in range(9)]
        texts += [" ".join(w), " ".join(w[:-1])]
    pairs = list(zip(texts[::2], texts[1::2], strict=True))
    assert all(0.8 <= similarity(a, b) < 0.85 for a, b in pairs)
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()) == list(range(0, len(texts), 2))


def test_least_common():
    for share in (0.8, 0.85):
        t = near_dedup.least_common(near_dedup.INDEXED, share)
        tail = lambda t: sum(math.comb(64, n) * share**n * (1 - share) ** (64 - n) for n in range(t))  # noqa: B023, E731
        assert tail(t) <= near_dedup.MISSED < tail(t + 1) and 25 < t < 45


def test_all_links_of_the_table_are_found(spark):
    """Every pair of the synthetic documents against the components, by brute force."""
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no synthetic tables")
    docs = spark.read.parquet(path)
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    for numerator in (80, 85):
        root = {i: i for i in sets}

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        ids, links = sorted(sets), 0
        for a in ids:
            for b in ids:
                if a < b and sets[a] and 100 * min(len(sets[a]), len(sets[b])) >= numerator * max(len(sets[a]), len(sets[b])):
                    c = len(sets[a] & sets[b])
                    if c and 100 * c >= numerator * (len(sets[a]) + len(sets[b]) - c):
                        links += 1
                        low, high = sorted((find(a), find(b)))
                        root[high] = low
        got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, numerator=numerator).collect()}
        assert got == {i: find(i) for i in ids} and links > 50
