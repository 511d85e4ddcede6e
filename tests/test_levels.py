"""The tree of schemas by a chain of explodes, and how its work is dealt out."""

import json
import re

import pytest

from weftgraph.operators.flatten import flatten
from weftgraph.plans import corpus

SCHEMA = "doc string, schema string, ordinal int, spec string"
ROWS = [
    ("d", "O", 0, '{"type":"object","properties":{"a":{"type":"string"},"b":{"type":"array","minItems":1,"items":{"$ref":"#/components/schemas/X"}},"c":{"type":"object","properties":{"e":{}}}},"required":["a"]}'),
    ("d", "Any", 1, '{"anyOf":[{"type":"string"},{"$ref":"#/components/schemas/O"},{"type":"object","properties":{"a":{"type":"integer"}}}]}'),
    ("d", "One", 2, '{"oneOf":[{"type":"object","properties":{"a":{"type":"integer"}}},{"type":"boolean"}]}'),
    ("d", "All", 3, '{"allOf":[{"$ref":"x.yaml#/components/schemas/O"},{"type":"array","items":{"type":"number","minItems":2}}]}'),
    ("e", "Broken", 0, "{"), ("e", "List", 1, '{"type":"object","properties":[1]}'), ("e", "Empty", 2, "{}"), ("e", "Array", 3, '{"type":"array","minItems":2}'),
]


def rows(df):
    return sorted(json.dumps(r.asDict(True), sort_keys=True) for r in df.collect())


@pytest.mark.parametrize("mode", ["shacl", "owl"])
@pytest.mark.parametrize("levels", [3, 5])
def test_chain_as_recursion(spark, mode, levels):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert rows(flatten(df, mode, levels)) == rows(flatten(df, mode))


def test_too_few_levels_fail(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    with pytest.raises(Exception, match="more than 2 levels"):
        flatten(df, "shacl", 2).select("doc").collect()
    with pytest.raises(Exception, match="more than 2 levels"):
        flatten(df, "shacl", 2).count()


def test_corpus_is_dealt_out_once(spark):
    plan = corpus.nodes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    first = next(line for line in plan.splitlines() if "Exchange " in line)
    assert "UnionLoop" not in plan and "REPARTITION_BY_NUM" in first


def test_recursion_is_dealt_out_first(spark):
    plan = flatten(spark.createDataFrame(ROWS, SCHEMA))._jdf.queryExecution().analyzed().toString()
    assert re.search(r"RepartitionByExpression \[doc#\d+, schema#\d+\], 4", plan)
