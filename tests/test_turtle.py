"""Turtle by subjects and trees: what is written is read back whole, documents of any size are written, failed tasks leave nothing."""

import json

import pytest
from pyspark.sql import functions as F
from test_rules import REF

from weftgraph.operators.flatten import flatten
from weftgraph.operators.rules import graph_set, owl_triples, shacl_triples
from weftgraph.sources.document_sink import write_files
from weftgraph.sources import sinks
from weftgraph.sources.sinks import parse_turtle, turtle_documents

P = "http://example.org/models/"
SCHEMAS = {
    "A": {"type": "object", "description": 'says "x"\n\tand \\ more', "required": ["e"], "properties": {"e": {"type": "string", "enum": [True, None, "a b", 3, 0.5, "http://x/y"]}, "l": {"type": "array", "minItems": 2, "items": REF}, "o": {"type": "object", "properties": {"i-j.k": {"type": "number", "minimum": 0.8}}}}},
    "U": {"oneOf": [{"type": "object", "properties": {"p": {"type": "string", "pattern": "^a$"}}}, {"anyOf": [{"type": "string"}, {"type": "integer"}]}, REF]}, "M": {"anyOf": [{"type": "string"}, {"type": "boolean"}, REF]},
    "E": {"type": "string", "enum": ["v", "w"]}, "c.v1": {"type": "integer"}, "c": {"type": "integer", "description": "again"},
}


def triples(spark, mode="shacl"):
    specs = spark.createDataFrame([(d, k, i, json.dumps(v)) for d in ("TS1_A", "dir/plain-x") for i, (k, v) in enumerate(SCHEMAS.items())], "doc string, schema string, ordinal int, spec string")
    return graph_set((owl_triples if mode == "owl" else shacl_triples)(flatten(specs, mode)))


def canonical(rows):
    """Triples with every blank node replaced by all that it holds."""
    by = {}
    for s, kind, p, o, o_kind, dt in rows:
        by.setdefault((s, kind), []).append((p, o, o_kind, dt))

    def whole(node):
        return "[" + ";".join(sorted(f"{p} {whole(o) if k == 'bnode' else (o, k, dt)}" for p, o, k, dt in by[node, "bnode"])) + "]"

    held = {o for v in by.values() for _, o, k, _ in v if k == "bnode"}
    return sorted([f"{s} {p} {whole(o) if k == 'bnode' else (o, k, dt)}" for (s, kind), v in by.items() if kind == "iri" for p, o, k, dt in v] + [whole(s) for s, kind in by if kind == "bnode" and s not in held])


@pytest.mark.parametrize("mode", ["shacl", "owl"])
def test_text_holds_the_whole_graph(spark, mode):
    t = triples(spark, mode).cache()
    rows = t.collect()
    for r in turtle_documents(t, P).collect():
        own = [(x.s, x.s_kind, x.p, x.o, x.o_kind, x.o_dt) for x in rows if (x.graph, x.doc) == (r.graph, r.doc)]
        assert canonical(parse_turtle(r.content)) == canonical(own)
        lines = r.content.split("\n")
        head = [x for x in lines if x.startswith("@prefix")]
        assert head == sorted(head) == lines[: len(head)] and r.content.endswith(" .\n")
        subjects = [x.split(" ")[0] for x in lines if x and not x.startswith((" ", "@", "[", "_"))]
        assert len(subjects) == len({x.s for x in rows if (x.graph, x.doc, x.s_kind) == (r.graph, r.doc, "iri")})


@pytest.mark.parametrize("mode", ["shacl", "owl"])
def test_read_by_statements(spark, mode):
    """Each statement is read by itself with its document's prefixes; together they hold every triple."""
    t = triples(spark, mode).cache()
    got = {(r.graph, r.doc): r.read for r in sinks.read_turtle_lines(sinks.turtle_lines(t, P)).collect()}
    assert got == {(r.graph, r.doc): r["count"] for r in t.groupBy("graph", "doc").count().collect()} and got


def test_statements(spark):
    text = {(r.graph, r.doc): r.content for r in turtle_documents(triples(spark), P).collect()}["rdf", "TS1_A"]
    assert 'TS1_A:c a rdfs:Class ;\n    rdfs:comment "again" .\n' in text and '@prefix TS1_A: <http://example.org/models/TS1/A#> .\n' in text and "@prefix sh:" not in text
    assert 'says \\"x\\"\\n\\tand \\\\ more' in text


def test_many_files_and_long_ones(spark, tmp_path):
    lines = spark.range(3000).select(F.concat(F.lit("a/f"), (F.col("id") % 1000).cast("string")).alias("file"), (-F.col("id")).alias("place"), F.concat("id", F.lit("\n")).alias("text"))
    long = spark.range(200_000).select(F.lit("long.txt").alias("file"), F.col("id").alias("place"), F.concat(F.col("id").cast("string"), F.lit(" line\n")).alias("text"))
    assert write_files(lines.unionByName(long), str(tmp_path)) == 1001
    assert (tmp_path / "a/f7").read_text() == "2007\n1007\n7\n" and len(list((tmp_path / "a").iterdir())) == 1000
    assert (tmp_path / "long.txt").read_text() == "".join(f"{i} line\n" for i in range(200_000))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "long.txt"]


def test_failed_tasks_leave_nothing(spark, tmp_path):
    (tmp_path / "f1").write_text("as it was")
    bad = spark.range(100).select(F.concat(F.lit("f"), F.col("id") % 5).alias("file"), F.col("id").alias("place"), F.when(F.col("id") == 73, F.raise_error(F.lit("no"))).otherwise("x").alias("text"))
    with pytest.raises(Exception, match="no"):
        write_files(bad, str(tmp_path))
    assert [p.name for p in tmp_path.rglob("*") if not p.name.startswith("_staging")] == ["f1"] and (tmp_path / "f1").read_text() == "as it was"


def test_portions_end_with_schemas(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(sinks, "_HELD", 5)
    rows = [("g", "d", tree, i) for tree, n in enumerate([3, 1, 12, 2, 2, 1]) for i in range(n)]
    for size in (1, 2, 4, 100):
        got = list(sinks._batched(pd.DataFrame(rows[a : a + size], columns=["graph", "doc", "tree", "i"]) for a in range(0, len(rows), size)))
        assert [tuple(r) for p in got for r in p.itertuples(index=False)] == rows
        assert all(set(a["tree"]).isdisjoint(b["tree"]) for a, b in zip(got, got[1:], strict=False)) and (size > 4 or len(got) > 2)
