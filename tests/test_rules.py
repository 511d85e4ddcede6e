"""One small schema for each tricky rule."""

import json
import os
import subprocess
import sys

import pytest

from weftgraph.functions.naming import DASH, RDF, RDFS, SH, XSD
from weftgraph.operators.flatten import flatten
from weftgraph.operators.rules import graph_set, owl_triples, shacl_triples

NS = "http://example.org/models/TS1/A#"


def graph(spark, schemas, convert=shacl_triples):
    rows = [("TS1_A", k, i, json.dumps(v)) for i, (k, v) in enumerate(schemas.items())]
    specs = spark.createDataFrame(rows, "doc string, schema string, ordinal int, spec string")
    return {(r.graph, r.s, r.p, r.o) for r in graph_set(convert(flatten(specs, "owl" if convert is owl_triples else "shacl"))).collect()}


def found(g, p, s=None):
    return sorted(o for _, a, b, o in g if b == p and (s is None or a == s))


REF = {"$ref": "#/components/schemas/Top"}


def test_property_and_default(spark):
    g = graph(spark, {"A": {"type": "object", "required": ["x"], "properties": {"x": {"type": "string"}, "y": {"type": "boolean"}}}})
    x, y = "_:TS1_A#/A/properties/x", "_:TS1_A#/A/properties/y"
    assert found(g, SH + "minCount", x) == ["1"] and found(g, SH + "datatype", x) == [XSD + "string"]
    assert found(g, SH + "nodeKind", y) == [SH + "IRI"] and found(g, SH + "datatype", y) == [] and found(g, RDFS + "range", NS + "y") == [XSD + "boolean"]


@pytest.mark.parametrize(("order", "kinds"), [((0, 1), []), ((1, 0), [SH + "IRI"])])
def test_all_of_depends_on_order(spark, order, kinds):
    branches = [REF, {"type": "object", "properties": {"p": {"type": "integer"}}}]
    g = graph(spark, {"A": {"allOf": [branches[i] for i in order]}})
    assert found(g, SH + "class", "_:TS1_A#/A") == [NS + "Top"] and found(g, SH + "nodeKind", "_:TS1_A#/A") == kinds
    assert len(found(g, SH + "targetClass")) == 2


def test_single_branch_takes_its_parents_place(spark):
    g = graph(spark, {"A": {"oneOf": [{"type": "boolean"}, {"type": "string"}]}})
    assert found(g, SH + "datatype", "_:TS1_A#/A") == [XSD + "string"] and not found(g, SH + "xone") and not found(g, SH + "nodeKind")


def test_mixed_union(spark):
    g = graph(spark, {"A": {"anyOf": [{"type": "string"}, {"type": "integer"}, {"$ref": "#/components/schemas/Obj"}]}})
    assert found(g, SH + "or_", "_:TS1_A#/A") and found(g, SH + "class", "_:TS1_A#/A") == [NS + "Obj"]
    assert len(found(g, SH + "class")) == 2 and len(found(g, SH + "datatype")) == 2


def test_object_branches_have_no_vocabulary(spark):
    g = graph(spark, {"A": {"oneOf": [{"type": "object", "properties": {"s": {"type": "string"}}}, {"type": "object", "properties": {"e": {"type": "string"}}}]}})
    assert found(g, SH + "xone") and not found(g, SH + "maxCount") and not any(o == RDF + "Property" for _, _, _, o in g)


def test_array_and_inline_object_and_alias(spark):
    g = graph(spark, {"A": {"type": "array", "minItems": 2, "items": {"type": "string"}}, "B": REF, "C": {"type": "object", "properties": {"o": {"type": "object", "properties": {"i": {"type": "number", "format": "float"}}}}}})
    assert found(g, SH + "node", "_:TS1_A#/A") == [DASH + "ListShape"] and found(g, SH + "minCount", "_:TS1_A#/A/items") == ["2"]
    assert not any(s == NS + "B" for _, s, _, _ in g)
    assert found(g, RDFS + "domain", NS + "i") == [NS + "C"] and found(g, SH + "nodeKind", "_:TS1_A#/C/properties/o") == [SH + "IRI"]
    assert found(g, SH + "targetClass").count(NS + "C") == 2


def test_enumeration_keeps_yaml_types(spark):
    g = graph(spark, {"A": {"type": "object", "properties": {"e": {"type": "string", "enum": [True, False, "Maybe", None, 1]}}}})
    assert sorted(found(g, RDF + "first")) == sorted(["true", "false", "Maybe", "NULL", "1"])


def test_empty_branches_and_dotted_names(spark):
    g = graph(spark, {"A": {"anyOf": [{"required": ["a"]}, {"required": ["b"]}]}, "a-b.v1": {"type": "string", "pattern": "^x$", "description": "d"}})
    assert {p for x, s, p, _ in g if s == "_:TS1_A#/A"} == {RDF + "type", SH + "targetClass", SH + "nodeKind"} or {p for x, s, p, _ in g if s == "_:TS1_A#/A"} == {RDF + "type", SH + "targetClass"}
    assert found(g, RDFS + "comment", NS + "a_b") == ["d"]


def test_owl_enum_and_cardinality(spark):
    g = graph(spark, {"E": {"type": "string", "enum": ["x-1", "y"]}, "A": {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer"}}}}, owl_triples)
    assert len([1 for _, _, p, o in g if o.endswith("NamedIndividual")]) == 2 and any(o.endswith("FunctionalProperty") for _, _, _, o in g)


def test_errors_stay_with_their_schema(spark):
    specs = spark.createDataFrame([("d", "A", 0, "{"), ("d", "B", 1, '{"type":"string"}')], "doc string, schema string, ordinal int, spec string")
    rows = {r.schema: r.error for r in flatten(specs).collect()}
    assert rows["B"] is None and rows["A"]


def test_files_to_turtle_and_back(spark, tmp_path):
    from weftgraph.plans.convert import convert
    from weftgraph.sources.sinks import parse_turtle, turtle_documents
    from weftgraph.sources.yaml_source import discover, read_specs

    (tmp_path / "TS1_A.yaml").write_text("openapi: 3.0.0\ncomponents:\n  schemas:\n    A:\n      type: object\n      properties:\n        e: {type: string, enum: [YES, NO, 'q\"']}\n")
    (tmp_path / "empty.yaml").write_text("")
    specs = read_specs(spark, discover(spark, [str(tmp_path)]))
    triples, errors = convert(specs)
    assert [r.doc for r in errors.collect()] == ["empty"]
    n = {r.graph: r["count"] for r in triples.groupBy("graph").count().collect()}
    for r in turtle_documents(triples, "http://example.org/models/").collect():
        assert len(parse_turtle(r.content)) == n[r.graph]


def test_base_namespace_leaves_other_files_alone(spark):
    a = {"A": {"type": "object", "properties": {"x": REF, "y": {"$ref": "TS2_B.yaml#/components/schemas/Y"}}}}
    g = graph(spark, a, lambda nodes: shacl_triples(nodes, base="urn:own#"))
    assert found(g, SH + "targetClass") == ["urn:own#A"] and found(g, SH + "class") == ["http://example.org/models/TS2/B#Y", "urn:own#Top"]


def test_turtle_of_other_writers():
    from weftgraph.sources.sinks import parse_turtle

    text = '@prefix a: <http://x/> . # said "so"\na:s.t a:p """two\nlines, "quoted" \\u00e9""", "de"@en, 8e-01, 0.5, -3, true ; a:q [ a:r ( a:x ) ] .\n'
    got = parse_turtle(text)
    assert [(o, (dt or "").removeprefix(XSD)) for s, _, p, o, _, dt in got if p == "http://x/p" and s == "http://x/s.t"] == [
        ('two\nlines, "quoted" é', ""), ("de", ""), ("8e-01", "double"), ("0.5", "decimal"), ("-3", "integer"), ("true", "boolean"),
    ]
    assert len(got) == 10


def test_queries_are_listed_without_a_session():
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), check=True)
