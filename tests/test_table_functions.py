"""Table functions in SQL: every row of a LATERAL join belongs to the row it was made of."""

import json

from weftgraph.functions.table_functions import register


def test_schemas_of_texts_and_nodes_of_schemas(spark):
    register(spark)
    deep = {"type": "string"}
    for _ in range(300):
        deep = {"type": "array", "items": deep}
    specs = {
        "a": json.dumps({"type": "object", "properties": {"x": {"$ref": "#/components/schemas/Y", "properties": {"no": {}}}, "y": {"oneOf": [{"type": "boolean"}, {}]}}}),
        "b": None, "c": "", "d": "[1]", "e": '{"items": 3, "properties": null}', "f": json.dumps(deep),
    }
    spark.createDataFrame(list(specs.items()), "id string, spec string").repartition(2).createOrReplaceTempView("some_specs")
    got = {(r.id, r.path): r for r in spark.sql("SELECT s.id, t.* FROM some_specs s, LATERAL schema_tree(s.spec) t").collect()}
    a = {p: (r.parent, r.depth, r.role, r.name, r.kind, r.ref) for (i, p), r in got.items() if i == "a"}
    assert a == {
        "": (None, 0, "schema", None, "object", None), "/properties/x": ("", 1, "property", "x", "ref", "#/components/schemas/Y"), "/properties/y": ("", 1, "property", "y", "oneOf", None),
        "/properties/y/oneOf/0": ("/properties/y", 2, "oneOf", None, "boolean", None), "/properties/y/oneOf/1": ("/properties/y", 2, "oneOf", None, "untyped", None),
    }
    assert not any(i == "b" for i, _ in got) and got["c", ""].error and got["d", ""].error
    assert {p for i, p in got if i == "e"} == {"", "/items"} and max(r.depth for (i, _), r in got.items() if i == "f") == 300
    whole = spark.sql("SELECT * FROM schema_trees(TABLE(SELECT spec, id AS doc, 'S' AS schema, 1 AS more FROM some_specs))").collect()
    assert sorted((r.doc, r.schema, r.path, str(r.kind)) for r in whole) == sorted((i, "S", p, str(r.kind)) for (i, p), r in got.items())
    texts = [("x/TS1_A.yaml", "components: {schemas: {A: {type: string}, B: {}}}"), ("bad.yaml", "a: ["), ("none.yaml", None)]
    spark.createDataFrame(texts, "path string, content string").createOrReplaceTempView("some_texts")
    rows = spark.sql("SELECT f.path AS file, t.schema, t.doc, n.kind, t.error IS NOT NULL AS failed FROM some_texts f, LATERAL yaml_schemas(f.path, f.content) t LEFT JOIN LATERAL schema_tree(t.spec) n ON true").collect()
    assert sorted((r.file, r.doc, str(r.schema), str(r.kind), r.failed) for r in rows) == [
        ("bad.yaml", "bad", "None", "None", True), ("none.yaml", "none", "None", "None", True), ("x/TS1_A.yaml", "TS1_A", "A", "string", False), ("x/TS1_A.yaml", "TS1_A", "B", "untyped", False),
    ]
