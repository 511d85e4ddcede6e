"""A training corpus from documents: five stages, each an operator of weftgraph.llm on all that the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents. SQL can express neither the language model of the first stage
nor the sketches and sampling of the others, so ORACLE_SQL is None and tests hold each
stage against a brute-force version.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import bpe, exact_dedup, langid, mixing, near_dedup
from weftgraph.llm.blocks import release
from weftgraph.llm.storage import scope, shared_dir, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Rows of a batch between Spark and Python, if the session sets none: whole texts of 10,000 rows would take tens of MB a task, several times over.
_BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def _stage(function):
    """The stage, which first lets go of the shuffle files of finished ones. Tables stay: results that are still read may need them."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark)
        if spark.conf.get(_BATCH[0], None) is None:
            spark.conf.set(*_BATCH)
        return function(spark, docs, sf_dir)

    return run_stage


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language is found, null texts and those without a letter; lang becomes the predicted language.

    If no document teaches a language, none is found in any, and all go.
    """
    taught = docs.where(~langid.held_out()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    profiles = stored(langid.learn_profiles(taught), "profiles")
    found = langid.identify(docs, profiles, carry=COLUMNS).where("lang_pred <> 'und'")
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


@_stage
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, with the largest doc_id."""
    return exact_dedup.without_copies(docs.select(*COLUMNS))


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, of a similarity of 0.8 or more, one row stays, with the smallest doc_id."""
    return near_dedup.without_near_copies(docs.select(*COLUMNS), numerator=80)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: not at all, once or twice."""
    return mixing.repeated(docs.select(*COLUMNS))


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""
    import public_tokenizers

    return bpe.encoding_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written as Parquet and read again by the next.

    A run owns the tables of its stages: what a stage wrote for itself goes when its
    output is written, and that output when the next one's is.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scope() as output:
            path = shared_dir(spark, f"stage-{name}")
        with scope() as own:
            stage(spark, docs, sf_dir).write.parquet(path)
        own.delete(spark)
        if before is not None:
            before.delete(spark)
        docs, before = spark.read.parquet(path), output
    return docs
