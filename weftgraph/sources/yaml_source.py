"""YAML documents in: discovery of paths, decoding, and one row for each top-level schema."""

from __future__ import annotations

import datetime
import json
from collections import Counter
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPEC = "doc string, path string, schema string, ordinal int, spec string, title string, version string, description string, url string, has_header boolean, error string"


def dedup_paths(paths: DataFrame) -> DataFrame:
    """paths(pos, path), each path once at its first position."""
    return paths.groupBy("path").agg(F.min("pos").alias("pos"))


def discover(spark: SparkSession, paths: list[str]) -> list[str]:
    """Files of the given paths, which must all exist: a folder gives its *.yaml files at any depth; anything else must end in .yaml."""
    out: list[str] = []
    for p in paths:
        if p.endswith(".yaml"):
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
                raise FileNotFoundError(f"{p} does not exist")
            out.append(p)
            continue
        found = sorted(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.yaml").load(p).inputFiles())
        if not found:
            raise ValueError(f"{p} is neither a .yaml file nor a folder with some")
        out += found
    return list(dict.fromkeys(out))


def _plain(x: Any) -> Any:
    if isinstance(x, dict):
        return {k if isinstance(k, str) else _bad_key(k): _plain(v) for k, v in x.items()}
    if isinstance(x, list):
        return [_plain(v) for v in x]
    return x.isoformat() if isinstance(x, (datetime.date, datetime.datetime)) else x


def _bad_key(k: Any) -> str:
    raise TypeError(f"{k!r} is no string key")


def decoded(path: str, content: str | bytes, strict: bool = True, whole: bool = False) -> list[dict[str, Any]]:
    """Rows of one document; one row with an error, or without a schema, if there are none. With whole, its path is its name."""
    import yaml

    base = {"doc": (path if whole else path.rsplit("/", 1)[-1]).removesuffix(".yaml"), "path": path, "ordinal": -1, "has_header": False}
    try:
        tree = yaml.load(content, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
        if tree is None and strict:
            raise ValueError("the document is empty")
        tree = tree or {}
        info, docs = tree.get("info") or {}, tree.get("externalDocs") or {}
        text = lambda v: None if v is None else str(v)
        base |= {"has_header": "openapi" in tree, "title": text(info.get("title")), "version": text(info.get("version")), "description": text(info.get("description")), "url": text(docs.get("url"))}
        schemas = tree["components"].get("schemas", {}) if "components" in tree else {}
        rows = [base | {"schema": str(k), "ordinal": i, "spec": json.dumps(_plain(v))} for i, (k, v) in enumerate(schemas.items())]
        return rows or [base]
    except Exception as e:
        return [base | {"error": f"{type(e).__name__}: {e}"}]


def read_specs(spark: SparkSession, files: list[str], strict: bool = True) -> DataFrame:
    """One row for each schema of each file. A file that fails is one row with its error; the others go on.

    A document goes by the name of its file, or, if several files have that, by its path.
    """
    count = Counter(f.rsplit("/", 1)[-1] for f in dict.fromkeys(files))
    shared = {n for n, k in count.items() if k > 1}
    names = [x.strip().split(" ")[0] for x in SPEC.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for path, content in batch.itertuples(index=False) for r in decoded(path, content, strict, path.rsplit("/", 1)[-1] in shared)]
            yield pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names, dtype=object)

    same = lambda c: F.regexp_replace(F.regexp_replace(c, r"^/", "file:/"), r"^file:/+", "file:/")
    read = spark.read.format("binaryFile").load(files).select(same(F.col("path")).alias("path"), "content")
    # Scans leave out empty files, which have to be reported: every file asked for is a row.
    asked = spark.createDataFrame([(f,) for f in files], "path string").select(same(F.col("path")).alias("path")).distinct()
    texts = asked.join(read, "path", "left").select("path", F.coalesce("content", F.lit(b"")).alias("content"))
    return texts.repartition("path").mapInPandas(run, SPEC)
