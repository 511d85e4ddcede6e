"""Shapes as checks of tables, row by row against what SHACL asks."""

import json

import pytest
from pyspark.sql import functions as F

from weftgraph.operators.flatten import flatten
from weftgraph.operators.rules import shacl_triples
from weftgraph.operators.validate import Table, violations

NS = "http://example.org/models/TS1/A#"
SCHEMAS = {
    "Owner": {"type": "object", "properties": {"mail": {"type": "string", "pattern": "@"}}},
    "Thing": {
        "type": "object", "required": ["id", "tags", "gone"],
        "properties": {
            "id": {"type": "integer"}, "whole": {"type": "integer"}, "tags": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "string", "maxLength": 3}}, "gone": {"type": "string"},
            "day": {"type": "string", "format": "date-time"}, "at": {"type": "string", "format": "date-time"}, "owner": {"$ref": "#/components/schemas/Owner"}, "home": {},
            "level": {"oneOf": [{"type": "integer", "minimum": 3}, {"type": "integer", "maximum": 5}]}, "kind": {"anyOf": [{"type": "string", "enum": ["a", "b"]}, {"type": "string", "minLength": 4}]},
        },
    },
}
ROWS = "id int, whole string, tags array<string>, day string, at timestamp, owner string, home string, level int, kind string, _key int, _link0 int"
GOOD = (1, "-7", ["abc"], "2020-02-29T01:02:03Z", None, "o", "http://x/y", 2, "a", 0, 0)


@pytest.fixture(scope="module")
def shapes(spark):
    specs = spark.createDataFrame([("TS1_A", n, i, json.dumps(s)) for i, (n, s) in enumerate(SCHEMAS.items())], "doc string, schema string, ordinal int, spec string")
    out = shacl_triples(flatten(specs)).distinct().persist()
    yield out
    out.unpersist()


def test_what_rows_fail(spark, shapes):
    rows = [
        GOOD,
        (2, "7.0", ["abcd", "x"], "2021-02-29T00:00:00Z", None, "nobody", "no iri", 4, "xyz", 0, 0),
        (3, None, [], None, None, None, None, None, None, 0, 0),
        (4, "+1", ["a", "b", "c"], "2020-01-01T00:00:00Z", None, "o", None, 6, "long", 0, 0),
        (None, "1", [None], None, None, None, None, None, None, 0, 0),
        (5, "1", None, None, None, None, None, None, None, 0, 0),
        (5, "1", None, None, None, None, None, None, None, 0, 0),
    ]
    tables = {NS + "Thing": Table(spark.createDataFrame(rows, ROWS), "id"), NS + "Owner": Table(spark.createDataFrame([("o", "a@b"), ("p", "ab"), (None, "ab"), ("o", "c@d")], "name string, mail string"), "name")}
    got = [(str(r["class"]).removeprefix(NS), r.focus, r.path, r.check, r.value) for r in violations(shapes, tables).collect() if r.path != "gone" or r.focus == "1"]
    n = None
    assert sorted(map(str, got)) == sorted(map(str, [
        ("Thing", "1", "gone", "minCount", n),
        ("Thing", "2", "whole", "datatype", "7.0"), ("Thing", "2", "tags[]", "items", '["abcd","x"]'), ("Thing", "2", "day", "datatype", "2021-02-29T00:00:00Z"), ("Thing", "2", "owner", "class", "nobody"),
        ("Thing", "2", "home", "nodeKind", "no iri"), ("Thing", "2", "level", "xone", "4"), ("Thing", "2", "kind", "or", "xyz"), ("Thing", "3", "tags[]", "minCount", "0"), ("Thing", "4", "tags[]", "maxCount", "3"),
        ("Thing", n, "id", "minCount", n), ("Thing", n, "tags[]", "items", "[null]"), ("Thing", "5", "tags", "minCount", n), ("Thing", "5", "tags", "minCount", n),
        ("Owner", "p", "mail", "pattern", "ab"), ("Owner", n, "mail", "pattern", "ab"),
    ]))


def test_empty_tables_unknown_classes_and_rows_that_may_be_meant(spark, shapes):
    things = Table(spark.createDataFrame([GOOD], ROWS), "id")
    owners = Table(spark.createDataFrame([("o", "a@b")], "name string, mail string"), "name")
    none = Table(owners.rows.limit(0), "name")
    failed = lambda t, **k: sorted((r.path, r.check) for r in violations(shapes, t, **k).collect())
    gone = ("gone", "minCount")
    assert failed({NS + "Thing": things, NS + "Owner": none}) == [gone, ("owner", "class")]
    assert failed({NS + "Thing": things, NS + "Owner": owners}, known={NS + "Owner": F.col("mail") == "x"}) == [gone, ("owner", "class")]
    assert failed({NS + "Thing": Table(things.rows.limit(0), "id"), NS + "Owner": owners, NS + "Other": owners}) == []
    with pytest.raises(ValueError, match="no table"):
        violations(shapes, {NS + "Thing": things})
