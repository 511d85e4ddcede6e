"""Arriving files: documents are independent, so each micro-batch is a conversion of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.naming import PREFIX
from ..plans.convert import converted
from ..sources.yaml_format import FORMAT, register


def stream_conversion(spark: SparkSession, folder: str, output: str, checkpoint: str, mode: str = "shacl", prefix: str = PREFIX) -> StreamingQuery:
    """Convert each new *.yaml file of a folder into Parquet triples under output/batch=<n>, errors under output/_errors/batch=<n>.

    A rerun batch overwrites its own. Which files belong to which batch stays below the checkpoint, in documents.
    """
    register(spark)
    documents = spark.readStream.format(FORMAT).option("strict", str(mode == "shacl").lower()).option("log", f"{checkpoint}/documents").load(folder)

    def batch(specs: DataFrame, number: int) -> None:
        specs = specs.persist()
        with converted(specs, mode, prefix) as (triples, errors):
            triples.write.mode("overwrite").parquet(f"{output}/batch={number}")
            errors.write.mode("overwrite").parquet(f"{output}/_errors/batch={number}")
        specs.unpersist()

    return documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
