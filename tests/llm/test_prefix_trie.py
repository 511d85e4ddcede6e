"""The trie of conversations against one of Python's, with shards of any size, and the LOUDS forest for itself."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from weftgraph.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, path string, n int"


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            label = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(conv, []).append(((turn is not None, turn or 0), label, (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    nodes = sorted({s[:d] for s in built.values() for d in range(len(s) + 1)}, key=len)
    members = {n: sorted(c for c, s in built.items() if s[: len(n)] == n) for n in nodes}
    children = {n: [m for m in nodes if len(m) == len(n) + 1 and m[:-1] == n] for n in nodes}
    leaves, saved = {}, {}
    for n in reversed(nodes):
        leaves[n] = sum(leaves[m] for m in children[n]) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        saved[n] = (len(members[n]) - 1) * words + sum(saved[m] for m in children[n])
    digest = lambda n: hashlib.sha256(",".join(str(c) for c in members[n] if built[c] == n).encode()).hexdigest()
    return sorted(((members[n][0], len(n), members[n[:-1]][0] if n else None, len(members[n]), len(children[n]), leaves[n], saved[n], digest(n)) for n in nodes), key=str)


def found(spark, rows):
    return sorted((tuple(r) for r in prefix_trie.trie_nodes(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()), key=str)


def some_rows(seed, convs=120):
    rng = random.Random(seed)
    said = ["", "a b", "a  b c", "Hello\nthere, you", None, "é ü\t z"]
    rows = []
    for c in [*range(-30, 0, 7), *range(0, convs)]:
        if c % 40 == 20:
            continue  # families without the conversation they begin with
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", None, "assistant"]), said[min(5, int(rng.expovariate(0.9)))]))
    return rows


@pytest.mark.parametrize("paths", [1, 3, 256])
def test_against_brute_force(spark, monkeypatch, paths):
    monkeypatch.setattr(prefix_trie.with_shards, "__defaults__", (paths,))
    monkeypatch.setattr(prefix_trie, "_FOREST", 16)
    monkeypatch.setattr(prefix_trie, "_IDS", 3)
    rows = some_rows(paths)
    # A hot conversation, a hot first turn, repeated rows and rows of no conversation.
    rows += [(1000 + c, t, "user", f"same {t}") for c in range(60) for t in range(4)] + [(2000 + c, t, "user", "same 0" if t == 0 else f"own {c % 9} {t}") for c in range(60) for t in range(3)]
    rows += rows[:10] + [(None, 1, "user", "nobody")]
    assert found(spark, rows) == brute(rows)


def test_small_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "a", "b")]) == []
    for rows in ([(20, 1, "a", "b")], [(c, 1, None, None) for c in range(1, 12)], [(7, t, "u", "word " * 50) for t in range(300)]):
        assert found(spark, rows) == brute(rows)


def test_forest_finds_its_paths():
    rng = np.random.default_rng(4)
    paths = [np.concatenate([[[t, t]], rng.integers(0, 3, (rng.integers(0, 6), 2))]).astype(np.uint64) for t in (0, 1, 2) for _ in range(30)]
    tree = np.repeat([0, 1, 2], 30)
    trie, end = prefix_trie.Louds.built(paths, [np.arange(len(p)) for p in paths], tree)
    different = {tuple(map(tuple, p[:d].tolist())) for p in paths for d in range(1, len(p) + 1)}
    assert len(trie) == len(different) and len(trie.bits) == 2 * len(trie) + 1 and trie.bits.sum() == len(trie)
    for p, e in zip(paths, end.tolist(), strict=True):
        node = -1
        for label in p.tolist():
            node = trie.child(node, tuple(label))
        assert node == e
    assert trie.child(0, (9, 9)) is None and (trie.degrees().sum() + 3) == len(trie)
