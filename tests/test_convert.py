"""The command line, files in and out, references that fail documents, the stream and the audits."""

import json

from test_rules import NS, graph

from weftgraph.functions.naming import PREFIX, RDF, RDFS, SH, XSD
from weftgraph.operators import audit, rules
from weftgraph.operators.flatten import flatten
from weftgraph.operators.rules import reference_errors, shacl_triples
from weftgraph.plans import convert as plan
from weftgraph.sources.sinks import parse_turtle

A = "openapi: 3.0.0\ninfo: {title: T, version: '1'}\ncomponents:\n  schemas:\n    A: {type: object, properties: {x: {type: string}}}\n"


def nodes(spark, schemas, doc="TS1_A"):
    rows = [(doc, k, i, json.dumps(v)) for i, (k, v) in enumerate(schemas.items())]
    return flatten(spark.createDataFrame(rows, "doc string, schema string, ordinal int, spec string"))


def test_command_line_writes_a_file_for_each_graph(spark, tmp_path, capsys):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/TS1_A.yaml").write_text(A)
    (tmp_path / "in/sub/TS2_B.yaml").write_text("paths: {}\n")
    (tmp_path / "in/bad.yaml").write_text("a: [")
    (tmp_path / "in/note.yml").write_text("not read")
    out = tmp_path / "out"
    assert plan.main([str(tmp_path / "in"), "--output", str(out)]) == 1
    assert sorted(str(p.relative_to(out)) for p in out.rglob("*.ttl")) == ["rdf/TS1_A_rdf.ttl", "rdf/TS2_B_rdf.ttl", "shacl/TS1_A_shacl.ttl", "shacl/TS2_B_shacl.ttl"]
    assert (out / "rdf/TS2_B_rdf.ttl").read_text() == "\n" and not list(out.glob("_*"))
    got = {(s, p, o) for s, _, p, o, _, _ in parse_turtle((out / "rdf/TS1_A_rdf.ttl").read_text())}
    assert (NS + "A", RDF + "type", RDFS + "Class") in got and (NS + "x", RDFS + "range", XSD + "string") in got
    said = capsys.readouterr()
    assert "3 documents, 2 converted, 1 failed" in said.out and "bad: " in said.err
    assert plan.main([str(tmp_path / "in/TS1_A.yaml"), "--format", "owl", "--output", str(out)]) == 0
    assert "owl:Class" in (out / "TS1_A.ttl").read_text()


def test_missing_paths_end_the_run(spark, tmp_path):
    (tmp_path / "TS1_A.yaml").write_text(A)
    out = tmp_path / "out"
    for path in ("none.yaml", "readme.txt"):
        assert plan.main([str(tmp_path / "TS1_A.yaml"), str(tmp_path / path), "--output", str(out)]) == 1 and not out.exists()


def test_files_of_one_name_are_documents_each(spark, tmp_path):
    for folder, text in (("a", A), ("b", "components: null\n")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "TS1_A.yaml").write_text(text)
    from weftgraph.sources.yaml_source import discover, read_specs

    with plan.converted(read_specs(spark, discover(spark, [str(tmp_path)]))) as (triples, errors):
        assert [r.doc.endswith("/b/TS1_A") for r in errors.collect()] == [True]
        assert {r.s for r in triples.where("graph = 'rdf'").collect()} == {NS + "A", NS + "x"}


def test_references_that_fail_a_document(spark):
    bad, lost, good = {"$ref": "TS2_B.yaml#/foo"}, {"$ref": "other.json#/X"}, {"$ref": "TS2_B.yaml#/components/schemas/Y"}
    n = nodes(spark, {"A": {"type": "object", "properties": {"x": bad, "y": lost, "z": good, "l": {"type": "array", "items": lost}}}, "U": {"oneOf": [lost, bad, good]}})
    found = lambda mode: sorted(r.error.rsplit(" ", 1)[1] for r in reference_errors(n, mode).collect())
    assert found("shacl") == ["TS2_B.yaml#/foo"] * 2 and found("owl") == ["TS2_B.yaml#/foo"] * 2 + ["other.json#/X"] * 2
    specs = spark.createDataFrame([("d", "A", 0, json.dumps({"type": "object", "properties": {"y": lost}})), ("e", "B", 0, json.dumps({"type": "object", "properties": {"y": good}}))], "doc string, schema string, ordinal int, spec string")
    for mode, docs in (("shacl", {"d", "e"}), ("owl", {"e"})):
        triples, errors = plan.convert(specs, mode)
        assert {r.doc for r in triples.collect()} == docs and {r.doc for r in errors.collect()} == {"d", "e"} - docs
        assert triples.where("o is null or s is null").count() == 0


def test_bounds_of_lists_of_lists(spark):
    g = graph(spark, {"A": {"type": "array", "minItems": 2, "items": {"type": "array", "minItems": 3, "maxItems": 5, "items": {"type": "string"}}}})
    bounds = {(s, p, o) for _, s, p, o in g if p in (SH + "minCount", SH + "maxCount")}
    items = "_:TS1_A#/A/items"
    assert bounds == {(items, SH + "minCount", "2"), (items + "/items", SH + "minCount", "3"), (items + "/items", SH + "maxCount", "5")}


def test_wanted_predicates_alone(spark):
    n = nodes(spark, {"A": {"type": "object", "required": ["e"], "properties": {"e": {"type": "string", "enum": ["a", "b"]}, "l": {"type": "array", "items": {"type": "integer"}}, "u": {"anyOf": [{"type": "string"}, {"type": "integer"}]}}}})
    every = shacl_triples(n).distinct().collect()
    for p in {r.p for r in every}:
        assert sorted(map(str, shacl_triples(n, predicates=(p,)).distinct().collect())) == sorted(str(r) for r in every if r.p == p), p


def test_external_prefixes(spark):
    n = nodes(spark, {"A": {"$ref": "TS3_C.yaml#/components/schemas/Z"}})
    got = {r.prefix: r.uri for r in rules.prefixes(n, external=["dir/TS9_D.yaml"]).collect()}
    assert got["TS9_D"] == PREFIX + "TS9/D#" and got["TS3_C"] == PREFIX + "TS3/C#" and got["sh"] == SH and "owl" not in got
    assert "owl" in {r.prefix for r in rules.prefixes(n, mode="owl").collect()}


def test_audits_find_what_is_wrong(spark):
    n = nodes(spark, {"A": {"type": "object", "description": "d", "properties": {"x-y": {"type": "string"}, "n": {"type": "number", "format": "float"}}}, "B": {"$ref": "#/components/schemas/A"}, "c.v1": {"type": "string"}})
    t = rules.graph_set(shacl_triples(n))
    row = audit.completeness(n, t).collect()[0]
    assert (row.schemas, row.schemas_found, row.schemas_missing, row.schemas_extra, row.properties, row.properties_percent, row.described, row.described_kept) == (3, 2, ["B", "c.v1"], ["c"], 2, 100.0, 1, 1)
    text = audit.report(audit.completeness(n, t)).collect()[0].report
    assert "- B\n- c.v1" in text and "- coverage: 33.3%" in text and "- kept: 100.0%" in text
    from pyspark.sql import functions as F

    assert audit.type_mismatches(n, t).count() == 0
    wrong = t.withColumn("o", F.when(F.col("o") == XSD + "float", XSD + "double").otherwise(F.col("o")))
    assert [(r.s.rsplit("/", 1)[1], r.expected, r.found) for r in audit.type_mismatches(n, wrong).collect()] == [("n", XSD + "float", XSD + "double")]
    lacks = t.where(~((F.col("p") == RDFS + "domain") & F.col("s").endswith("#n")))
    assert [r.s for r in audit.lacking(lacks, RDFS + "domain").collect()] == [NS + "n"]


def test_stream_of_files(spark, tmp_path):
    from weftgraph.streaming.incremental import stream_conversion

    (tmp_path / "in").mkdir()
    run = lambda: stream_conversion(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    (tmp_path / "in/TS1_A.yaml").write_text(A)
    (tmp_path / "in/bad.yaml").write_text("a: [")
    assert run()
    first = spark.read.parquet(str(tmp_path / "out")).count()
    (tmp_path / "in/TS2_B.yaml").write_text(A)
    assert run()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert first and out.count() == 2 * first and {r.doc for r in out.collect()} == {"TS1_A", "TS2_B"}
    assert [r.doc for r in spark.read.parquet(str(tmp_path / "out/_errors")).collect()] == ["bad"]
