"""Shared lines against Python's dicts, on ranges that cut hot lines into pieces."""

import hashlib
import random
from collections import defaultdict

import pyarrow as pa
import pytest

from weftgraph.llm import line_dedup

SCHEMA = "doc_id long, text string, kept string, content int"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(rows):
    have = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                have[key(line)].add(-(1 << 63) if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        gone = [len(have[key(x)]) >= 3 and max(have[key(x)]) != (-(1 << 63) if i is None else i) for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        out.append((i, len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    return sorted((tuple(r) for r in line_dedup.line_digests(df).collect()), key=str)


def some_rows(seed, n=150):
    rng = random.Random(seed)
    lines = ["A line that Many documents have", " a line that many documents have\r", "twenty code points: é", "nineteen points: éa", "", "short", "another line, of two documents", "x" * 5000, "\x0b ÉCOLE and ÉTUDE are unlike \x0c"]
    rows = [(i, "\n".join(rng.choice([*lines, f"a line of its own, number {i}", f"a line of a few, number {i % 40}"]) for _ in range(rng.randrange(0, 30)))) for i in range(n)]
    return [*rows, (None, lines[0] + "\n" + lines[6]), (None, "a line of a few, number 1"), (7, "a line of a few, number 1\nA LINE THAT MANY DOCUMENTS HAVE"), rows[5], rows[5], (9000, None), (9001, "\n")]


@pytest.mark.parametrize("partitions", [1, 4, 61])
def test_against_brute_force(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = some_rows(partitions)
        assert found(spark, rows) == brute(rows)
        assert found(spark, []) == [] and found(spark, [(1, None)]) == brute([(1, None)])
        hot = [(i, "the very line that everybody has got") for i in range(300)]
        assert found(spark, hot) == brute(hot)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_ranges_in_any_batches(size):
    """Rows of a range give the same decisions however they come in batches; both ends of the range stay open."""
    rng = random.Random(3)
    rows = sorted({(rng.randrange(12), 0, rng.randrange(6), 5, rng.randrange(4)) for _ in range(200)} | {(50, 0, 1, 5, 0), (50, 0, 2, 5, 0)}, key=lambda r: (r[0], r[1], -r[2], r[4]))
    names = ["high", "low", "doc", "content", "place"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[a : a + size]], t) for c, t in enumerate(kinds)], names=names) for a in range(0, len(rows), size)]
    out = [tuple(r.values()) for b in line_dedup._streamed(3)(iter(batches)) for r in b.to_pylist()]
    docs = defaultdict(set)
    for r in rows:
        docs[r[0]].add(r[2])
    inside = [h for h in docs if h not in (rows[0][0], 50)]
    want = sorted((r[2], r[3], r[4]) for r in rows if r[0] in inside and len(docs[r[0]]) >= 3 and r[2] != max(docs[r[0]]))
    assert sorted(r[2:] for r in out if r[0] is None) == want
    assert sorted(r for r in out if r[0] == rows[0][0]) == sorted(r for r in rows if r[0] == rows[0][0])
    assert sorted((r[2], r[4]) for r in out if r[0] == 50) == [(1, -1), (1, 0), (2, -1), (2, 0)]


def test_bitmaps():
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([[0, 9]], pa.list_(pa.int32()))], names=["doc", "content", "places"])
    row = next(line_dedup._packed(iter([batch]))).to_pylist()[0]
    text = "\n".join(map(str, range(20)))
    assert row["n_dropped"] == 2 and line_dedup.kept_lines(text, row["keep"]) == "\n".join(str(i) for i in range(20) if i not in (0, 9))
    assert line_dedup.kept_lines("a\nb", None) == "a\nb"
