"""What is a class of the ontology, and what its lists hold."""

import json

from weftgraph.functions.naming import OWL, RDF, RDFS, XSD
from weftgraph.operators.flatten import flatten
from weftgraph.operators.rules import graph_set, owl_triples


def owl(spark, schemas, **more):
    rows = [("TS1_A", k, i, json.dumps(v)) for i, (k, v) in enumerate(schemas.items())]
    nodes = flatten(spark.createDataFrame(rows, "doc string, schema string, ordinal int, spec string"), "owl")
    return {(r.s, r.p, r.o) for r in graph_set(owl_triples(nodes, **more)).collect()}


def members(g, head):
    cell, found = next(o for s, p, o in g if p == OWL + "oneOf" and s.endswith(f"#{head}")), []
    while cell != RDF + "nil":
        found.append(next(o for s, p, o in g if s == cell and p == RDF + "first"))
        cell = next(o for s, p, o in g if s == cell and p == RDF + "rest")
    return [x.rsplit("#", 1)[1] for x in found]


def classes(g):
    return sorted(s.rsplit("#", 1)[1] for s, p, o in g if p == RDF + "type" and o == OWL + "Class")


OPTIONS = [{"$ref": "#/components/schemas/B-x"}, {"type": "string"}, {"$ref": "TS2_C.yaml#/components/schemas/Y"}, {"$ref": "elsewhere"}]


def test_references_of_one_of_are_listed(spark):
    g = owl(spark, {"A": {"oneOf": OPTIONS}, "N": {"oneOf": [{"type": "string"}]}, "E": {"type": "string", "enum": ["v"]}})
    assert members(g, "A") == ["B_x", "Y"] and members(g, "E") == ["v"] and sum(p == OWL + "oneOf" for _, p, _ in g) == 2 and classes(g) == ["A", "E", "N"]


def test_types_and_references_do_not_hide_unions(spark):
    """A schema is an object or an enumeration by its type alone, and a union by oneOf whatever else it has."""
    g = owl(spark, {"S": {"type": "string", "oneOf": OPTIONS}, "R": {"$ref": "#/x", "oneOf": OPTIONS}, "L": {"type": "array", "oneOf": OPTIONS}, "M": {"anyOf": [{}], "oneOf": OPTIONS},
                    "O": {"$ref": "#/x", "type": "object", "properties": {"p": {"type": "integer"}}}, "Q": {"$ref": "#/x", "type": "string", "enum": ["v"]},
                    "P": {"type": "object", "oneOf": OPTIONS}, "no": {"type": "string"}, "none": {"$ref": "#/x"}})
    assert classes(g) == ["L", "M", "O", "P", "Q", "R", "S"]
    for name in "SRLM":
        assert members(g, name) == ["B_x", "Y"]
    assert members(g, "Q") == ["v"] and {(s.rsplit("#", 1)[1], o) for s, p, o in g if p == RDFS + "range"} == {("p", XSD + "integer")}


def test_values_labels_and_ranges(spark):
    g = owl(spark, {"A-b": {"type": "string", "enum": [True, None, 1, "x-y.z"]}, "O": {"type": "object", "required": ["a-b"], "properties": {"a-b": {"type": "boolean", "anyOf": []}}}})
    assert members(g, "A_b") == ["True", "None", "1", "x_y"]
    said = {(s.rsplit("#", 1)[1], p.rsplit("#", 1)[1], o) for s, p, o in g}
    assert ("True", "comment", "Indicates that the A b value is True.") in said and ("x_y", "label", "x-y.z") in said and ("None", "label", "None") in said
    assert ("a_b", "label", "a b") in said and ("a_b", "comment", "Property representing the a b.") in said and ("a_b", "range", XSD + "boolean") in said and ("a_b", "minCardinality", "1") in said


def test_wanted_predicates_alone(spark):
    schemas = {"A": {"oneOf": OPTIONS}, "E": {"type": "string", "enum": ["v", "w"]}, "O": {"type": "object", "required": ["a"], "properties": {"a": {"type": "object", "properties": {"b": {"type": "array", "items": {"type": "number"}}}}}}}
    every = owl(spark, schemas)
    for p in {p for _, p, _ in every}:
        assert owl(spark, schemas, predicates=(p,)) == {t for t in every if t[1] == p}, p
