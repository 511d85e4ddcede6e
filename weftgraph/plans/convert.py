"""From files to graphs: the whole conversion as one plan, and its command line."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.naming import PREFIX, file_stem
from ..operators.flatten import flatten
from ..operators.rules import graph_set, owl_header, owl_triples, reference_errors, shacl_triples
from ..sources.sinks import turtle_lines, write_ntriples, write_parquet, write_turtle
from ..sources.yaml_source import discover, read_specs

__version__ = "0.1.0"


def convert(
    specs: DataFrame, mode: str = "shacl", prefix: str = PREFIX, compat: bool = True, base: str | None = None, nodes: DataFrame | None = None,
    hold: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> tuple[DataFrame, DataFrame]:
    """(triples, errors(doc, error)) of specs; a document with an error gives no triples.

    nodes: those of specs, if they have been worked out already. hold: what to do with the
    documents that fail, such as `tables.kept`; a table of a known size, if small, spares
    a shuffle of all nodes by document.
    """
    nodes = flatten(specs.where("spec is not null"), mode) if nodes is None else nodes
    errors = nodes.where("error is not null").select("doc", "error").unionByName(reference_errors(nodes, mode))
    if "error" in specs.columns:
        errors = errors.unionByName(specs.where("error is not null").select("doc", "error"))
    failed = hold(errors.select("doc").distinct())
    good = nodes.join(failed, "doc", "left_anti")
    if mode == "owl":
        triples = owl_triples(good, base or prefix)
        if "has_header" in specs.columns:
            headers = specs.where("has_header and error is null").select("doc", "title", "version", "description", "url").distinct()
            triples = triples.unionByName(owl_header(headers.join(failed, "doc", "left_anti"), base or prefix))
    else:
        triples = shacl_triples(good, prefix, compat, base)
    return graph_set(triples), errors


@contextmanager
def converted(specs: DataFrame, mode: str = "shacl", *args, **options) -> Iterator[tuple[DataFrame, DataFrame]]:
    """What `convert` gives, over nodes and triples that are worked out once and let go at the end."""
    nodes = flatten(specs.where("spec is not null"), mode).persist()
    triples, errors = convert(specs, mode, *args, nodes=nodes, **options)
    triples = triples.persist()
    try:
        yield triples, errors
    finally:
        triples.unpersist()
        nodes.unpersist()


def turtle_files(specs: DataFrame, triples: DataFrame, errors: DataFrame, mode: str = "shacl", prefix: str = PREFIX, base: str | None = None) -> DataFrame:
    """(graph, doc, place, text): the lines of every document that went well, an empty one where it has no triples.

    Of documents with one name the last in order stays.
    """
    graphs = F.explode(F.array(*map(F.lit, ("owl",) if mode == "owl" else ("rdf", "shacl"))))
    every = specs.select("doc").distinct().join(errors.select("doc").distinct(), "doc", "left_anti").select(graphs.alias("graph"), "doc")
    every = every.groupBy("graph", file_stem(F.col("doc"))).agg(F.max("doc").alias("doc")).select("graph", "doc")
    lines = turtle_lines(triples.join(every, ["graph", "doc"], "left_semi"), prefix, base)
    empty = every.join(triples.select("graph", "doc").distinct(), ["graph", "doc"], "left_anti")
    return lines.unionByName(empty.select("graph", "doc", F.struct(F.lit(0).alias("part"), F.lit("").alias("key")).alias("place"), F.lit("\n").alias("text")))


def main(argv: list[str] | None = None) -> int:
    """Convert YAML files and folders; 0 if every document went well."""
    p = argparse.ArgumentParser(prog="weftgraph", description=main.__doc__)
    p.add_argument("paths", nargs="+")
    p.add_argument("--format", choices=("shacl", "owl"), default="shacl")
    p.add_argument("--namespace-prefix", dest="prefix", default=PREFIX)
    p.add_argument("--base-namespace", help="the namespace of all documents of the run, instead of one made of prefix and name")
    p.add_argument("--output", default="output")
    p.add_argument("--sink", choices=("turtle", "ntriples", "parquet"), default="turtle")
    p.add_argument("--version", action="version", version=__version__)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("weftgraph").getOrCreate()
    try:
        files = discover(spark, a.paths)
    except Exception as e:
        print(e, file=sys.stderr)
        return 1
    specs = read_specs(spark, files, a.format == "shacl")
    with converted(specs, a.format, a.prefix, base=a.base_namespace) as (triples, errors):
        if a.sink == "turtle":
            write_turtle(turtle_files(specs, triples, errors, a.format, a.prefix, a.base_namespace), a.output)
        else:
            (write_ntriples if a.sink == "ntriples" else write_parquet)(triples, a.output)
        failed = errors.groupBy("doc").agg(F.min("error").alias("error")).collect()  # a row for some of the files that the driver listed
    for r in failed:
        print(f"{r.doc}: {r.error}", file=sys.stderr)
    print(f"{len(files)} documents, {len(files) - len(failed)} converted, {len(failed)} failed")
    return int(bool(failed))


if __name__ == "__main__":
    sys.exit(main())
