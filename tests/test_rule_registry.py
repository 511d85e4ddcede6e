"""Rules as values: what the planner takes, and rules of one's own."""

import json

import pytest
from pyspark.sql import functions as F

from weftgraph.functions.naming import OWL, RDF, RDFS, SH
from weftgraph.operators import rules
from weftgraph.operators.flatten import flatten

SCHEMAS = {
    "A": {"type": "object", "deprecated": True, "description": "an A", "required": ["e"], "properties": {
        "e": {"type": "string", "enum": ["a", "b"], "pattern": "x"}, "n": {"type": "integer", "minimum": 1, "maximum": 3}, "r": {"$ref": "#/components/schemas/B"},
        "l": {"type": "array", "minItems": 1, "maxItems": 4, "items": {"type": "number", "format": "float"}}, "b": {"type": "boolean"},
        "u": {"anyOf": [{"type": "string"}, {"type": "integer"}, {"$ref": "#/components/schemas/B"}]}, "o": {"type": "object", "properties": {"i": {"type": "string", "maxLength": 3}}},
    }},
    "B": {"oneOf": [{"type": "object", "properties": {"x": {"type": "string", "minLength": 1}}}, {"type": "object", "properties": {"y": {}}}]},
    "E": {"type": "string", "enum": ["x-1", True, None]}, "U": {"oneOf": [{"$ref": "#/components/schemas/A"}, {"$ref": "#/components/schemas/B"}]},
    "L": {"type": "array", "items": {"$ref": "#/components/schemas/A"}}, "W": {"allOf": [{"$ref": "#/components/schemas/A"}, {"type": "object", "nullable": True}]}, "V": {},
}


def nodes(spark, mode="shacl", schemas=SCHEMAS):
    rows = [("TS1_A", k, i, json.dumps(v)) for i, (k, v) in enumerate(schemas.items())]
    return flatten(spark.createDataFrame(rows, "doc string, schema string, ordinal int, spec string"), mode)


@pytest.mark.parametrize(("mode", "compat"), [("shacl", True), ("shacl", False), ("owl", True)])
def test_rules_make_what_they_declare(spark, mode, compat):
    """Every rule alone, over all nodes: only its graph and predicates, and nothing outside its kinds."""
    given, own = (rules.owl_nodes(nodes(spark, "owl")), rules.owl_rules()) if mode == "owl" else (rules.shacl_nodes(nodes(spark)), rules.shacl_rules(compat=compat))
    made = F.array(*(F.struct(F.lit(i).alias("rule"), (r.triples if r.many else F.array(r.triples)).cast(rules._STRUCTS).alias("ts")) for i, r in enumerate(own)))
    rows = given.select("kind", F.explode(made).alias("m")).select("kind", "m.rule", F.explode("m.ts").alias("t")).where("t is not null").select("kind", "rule", "t.graph", "t.p").distinct().collect()
    assert len(rows) > 20
    for row in rows:
        rule = own[row.rule]
        assert row.graph == rule.graph and row.p in rule.predicates and (rule.kinds is None or row.kind in rule.kinds), (rule.name, row)


def test_planner():
    own = rules.shacl_rules()
    chosen, kinds = rules.plan_rules(own, predicates=(SH + "pattern", SH + "maxInclusive"))
    assert [r.name for r in chosen] == ["pattern", "greatest"] and kinds == {"string", "integer", "number"}
    chosen, kinds = rules.plan_rules(own, graphs=("rdf",))
    assert {r.graph for r in chosen} == {"rdf"} and kinds is None
    assert rules.plan_rules(own) == (own, None) and rules.plan_rules(own, predicates=("urn:none",)) == ([], set())
    with pytest.raises(ValueError, match="one name"):
        rules.plan_rules([*own, own[0]])


def test_pruned_triples_are_those_of_all_rules(spark):
    shacl, owl = nodes(spark), nodes(spark, "owl")
    every = rules.shacl_triples(shacl).distinct().collect()
    for graph in ("rdf", "shacl"):
        assert sorted(map(str, rules.shacl_triples(shacl, graphs=(graph,)).distinct().collect())) == sorted(str(r) for r in every if r.graph == graph)
    every = rules.owl_triples(owl).distinct().collect()
    for p in {r.p for r in every}:
        assert sorted(map(str, rules.owl_triples(owl, predicates=(p,)).distinct().collect())) == sorted(str(r) for r in every if r.p == p), p
    assert rules.shacl_triples(shacl, predicates=("urn:none",)).count() == 0


def test_only_nodes_of_the_declared_kinds_are_exploded(spark):
    plan = rules.shacl_triples(nodes(spark), predicates=(SH + "pattern",))._jdf.queryExecution().optimizedPlan().toString()
    assert "string" in plan and "Enumeration" not in plan and RDFS not in plan


def test_rules_of_ones_own(spark):
    deprecated = rules.Rule("deprecated class", "rdf", (OWL + "deprecated",), F.when(F.col("deprecated"), rules.triple("rdf", F.col("_owner"), OWL + "deprecated", "true", "literal")), ("object",))
    words = F.transform(F.split("description", " "), lambda w: rules.triple("rdf", F.col("_owner"), "urn:word", w, "literal"))
    told = rules.Rule("words", "rdf", ("urn:word",), F.when(F.col("role") == "schema", words), many=True)
    alone = rules.shacl_triples(nodes(spark), predicates=("urn:word", OWL + "deprecated"), more=[deprecated, told])
    assert {(r.s[-2:], r.p, r.o) for r in alone.collect()} == {("#A", "urn:word", "an"), ("#A", "urn:word", "A"), ("#A", OWL + "deprecated", "true")}
    refers = rules.Rule("refers", "rdf", ("urn:refers",), F.when(F.col("role") == "property", rules.triple("rdf", F.col("_prop"), "urn:refers", F.col("_uri"))), ("ref",))
    asked = rules.shacl_triples(nodes(spark), predicates=("urn:refers", OWL + "deprecated"), more=[deprecated, refers]).where("p = 'urn:refers'")
    assert [(r.s[-2:], r.o[-2:]) for r in asked.collect()] == [("#r", "#B")]  # not the inline object o, which only the other rule reads
    both = rules.graph_set(rules.shacl_triples(nodes(spark), more=[deprecated, told]))
    assert both.count() == rules.graph_set(rules.shacl_triples(nodes(spark))).count() + 3
    marked = rules.Rule("marked", "owl", (RDF + "type",), F.when(F.col("role") == "schema", rules.triple("owl", F.col("_me"), RDF + "type", "urn:Marked")))
    assert rules.owl_triples(nodes(spark, "owl"), more=[marked]).where("o = 'urn:Marked'").count() == len(SCHEMAS)
