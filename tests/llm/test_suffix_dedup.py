"""Suffix removal against brute force where hashes are hot, texts periodic and copies many."""

import hashlib
import random

import numpy as np
import pytest

from weftgraph.llm import suffix_dedup


def brute(texts):
    first, out = {}, {}
    for i in sorted(texts):
        t = texts[i].encode()
        for k in range(len(t) - 49):
            first.setdefault(t[k : k + 50], i)
    for i, text in texts.items():
        t = text.encode()
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < i:
                gone[k : k + 50] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()
    return out


def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts = {}
    for i in range(240):
        own = [rng.choice(words) for _ in range(rng.randrange(5, 120))]
        at = rng.randrange(len(own))
        piece = passage[rng.randrange(40) : rng.randrange(60, len(passage))] if i % 2 else ""
        texts[i * 3 + 1] = " ".join(own[:at]) + piece + " ".join(own[at:])
    texts |= {900: "ab" * 700, 901: "x" + "ab" * 300, 902: "a" * 1000, 903: "a" * 49, 904: "a" * 50, 905: "", 906: "ba" * 400}
    texts |= {1000 + i: texts[4] for i in range(120)}  # one text is a third of all rows
    return texts


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 3, 0])
def test_hot_hashes_and_copies(spark, hot):
    texts = corpus()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs, hot=hot).collect()}
    assert got == brute(texts)


def test_orders_are_proved_and_mended(monkeypatch):
    rng = np.random.default_rng(3)
    data = np.concatenate([rng.integers(97, 99, 700).astype(np.uint8), np.zeros(60, np.uint8)])
    data[400:600] = data[:200]
    starts, group = np.arange(650), np.arange(650) % 3
    want = sorted(range(650), key=lambda i: (group[i], data[i : i + 26].tobytes(), i))
    order, common = suffix_dedup.sorted_suffixes(data, starts, 26, group)
    assert order.tolist() == want
    for x in range(1, 650):
        p, q = (data[want[x + d] : want[x + d] + 26].tolist() for d in (-1, 0))
        n = next((k for k in range(26) if p[k] != q[k]), 26)
        assert common[x] == (n if group[want[x]] == group[want[x - 1]] else -1)
    monkeypatch.setattr(suffix_dedup, "extensions", lambda d, s, limit: np.zeros((len(s), limit + 1), np.uint64))  # every hash deceives
    order, again = suffix_dedup.sorted_suffixes(data, starts, 26, group)
    assert order.tolist() == want and again.tolist() == common.tolist()
