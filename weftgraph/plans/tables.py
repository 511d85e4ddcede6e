"""Tables that a plan reads more than once, and folders that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _checkpoints(spark: SparkSession) -> str:
    """The session's folder for checkpoints, spark.checkpoint.dir unless it has been set already.

    Only a session in local mode, as in tests, may leave that setting out.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="weftgraph-"))
    return context.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """The same rows, worked out once and written as Parquet below spark.checkpoint.dir, where lost executors leave them alone.

    Columns that a plan does not need are not read again, and the rows are compressed.
    """
    path = shared_folder(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let_go(df: DataFrame) -> None:
    """Delete the files of a result of `kept` that no plan reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A path for files of one's own below the folder for checkpoints; nothing is there yet."""
    return f"{_checkpoints(spark)}/{name}-{uuid.uuid4().hex}"
