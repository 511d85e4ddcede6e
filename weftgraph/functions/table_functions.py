"""Table functions for SQL, by `register`: schemas of YAML texts and nodes of schemas.

yaml_schemas(path, content): the rows of `yaml_source.SPEC` of one document, an error row
for one that cannot be read; a null content counts as an empty document.
schema_tree(spec): the nodes of a schema given as JSON, from its root down in the order of
the text: path, parent (null at the root), depth, role (schema, property, items, anyOf,
oneOf, allOf), name (of a property), kind, ref, error. Null gives no row, a text that is
no JSON object one row with an error.
schema_trees(TABLE(...)): the same for a table with columns doc, schema and spec, which go
before the rest. It takes Arrow batches of a table; the other two stand in LATERAL joins,
which Spark denies to Arrow functions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf, udtf

from ..sources.yaml_source import SPEC, decoded

TREE = "path string, parent string, depth int, role string, name string, kind string, ref string, error string"
_TYPES = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
_COMBINATORS = ("anyOf", "oneOf", "allOf")


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _TYPES[t]) for n, t in (x.split() for x in ddl.split(","))])


_NAMES = _schema(TREE).names


def _kind(node: dict) -> str:
    if "$ref" in node:
        return "ref"
    if node.get("type") in ("object", "array", "string", "integer", "number"):
        return node["type"]
    return next((k for k in _COMBINATORS if k in node), "boolean" if node.get("type") == "boolean" else "untyped")


def _below(node: dict) -> Iterator[tuple[str, str, str | None, Any]]:
    """(step, role, name, child); a reference has nothing below it."""
    if "$ref" in node:
        return
    if isinstance(node.get("properties"), dict):
        yield from ((f"/properties/{k}", "property", k, v) for k, v in node["properties"].items())
    if "items" in node:
        yield "/items", "items", None, node["items"]
    for word in _COMBINATORS:
        if isinstance(node.get(word), list):
            yield from ((f"/{word}/{i}", word, None, v) for i, v in enumerate(node[word]))


def tree(spec: str) -> list[dict[str, Any]]:
    try:
        root = json.loads(spec)
        if not isinstance(root, dict):
            raise ValueError("a schema is an object")
    except ValueError as e:
        return [{"path": "", "depth": 0, "role": "schema", "error": f"{type(e).__name__}: {e}"}]
    rows, stack = [], [("", None, 0, "schema", None, root)]
    while stack:
        path, parent, depth, role, name, node = stack.pop()
        node = node if isinstance(node, dict) else {}
        ref = node.get("$ref")
        rows.append({"path": path, "parent": parent, "depth": depth, "role": role, "name": name, "kind": _kind(node), "ref": ref if isinstance(ref, str) else None})
        stack += [(path + step, path, depth + 1, r, n, child) for step, r, n, child in reversed(list(_below(node)))]
    return rows


@udtf(returnType=TREE)
class SchemaTree:
    def eval(self, spec: str) -> Iterator[tuple]:
        if spec is not None:
            yield from (tuple(r.get(n) for n in _NAMES) for r in tree(spec))


@udtf(returnType=SPEC)
class YamlSchemas:
    def eval(self, path: str, content: str) -> Iterator[tuple]:
        names = _schema(SPEC).names
        yield from (tuple(r.get(n) for n in names) for r in decoded(path or "", content or ""))


@arrow_udtf(returnType=f"doc string, schema string, {TREE}")
class SchemaTrees:
    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        rows = []
        for at in batch.select(["doc", "schema", "spec"]).to_pylist():
            spec = at.pop("spec")
            rows += [at | r for r in tree(spec)] if spec is not None else []
        yield pa.Table.from_pylist(rows, schema=_schema(f"doc string, schema string, {TREE}"))


def register(spark: SparkSession) -> None:
    spark.udtf.register("schema_tree", SchemaTree)
    spark.udtf.register("yaml_schemas", YamlSchemas)
    spark.udtf.register("schema_trees", SchemaTrees)
