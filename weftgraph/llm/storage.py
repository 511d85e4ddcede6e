"""Where intermediate tables go: the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Names of files that are sent to every task at most.
FILES = 1 << 16


class Scope:
    """The folders handed out inside a `with scope()` block of this thread."""

    def __init__(self) -> None:
        self.folders: list[str] = []

    def delete(self, spark: SparkSession, *read: DataFrame) -> None:
        """Delete the tables of this scope, but for those that `read`, results of `stored`, still need."""
        files = [f for df in read for f in df.inputFiles()]
        for folder in [x for x in self.folders if not any(x.rsplit("/", 1)[1] in f for f in files)]:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            self.folders.remove(folder)


_current: ContextVar[Scope | None] = ContextVar("scope", default=None)


@contextmanager
def scope() -> Iterator[Scope]:
    """Whoever opens a scope may delete the tables made inside; what it leaves belongs to the scope around it.

    Outside of any scope tables stay: a query that was returned reads them when it runs.
    """
    own, outer = Scope(), _current.get()
    token = _current.set(own)
    try:
        yield own
    finally:
        _current.reset(token)
        if outer is not None:
            outer.folders += own.folders


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder URI under spark.checkpoint.dir.

    Only a session in local mode, as in tests, may leave that setting out.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="weftgraph-")
        context._conf.set("spark.checkpoint.dir", base)
        context.setCheckpointDir(base)
    folder = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if (own := _current.get()) is not None:
        own.folders.append(folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written as Parquet in the shared folder and read again: lineage ends here."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _plain_scan(df: DataFrame) -> bool:
    """Whether the rows are those of Parquet files, each at most once."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter") and plan.deterministic():
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and plan.toString().strip().endswith("] parquet")


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """The same rows with a number that no other row has, and the name of its column.

    Rows of Parquet files go by file and place, which every reading finds again, if the
    names of the files are few enough to be sent to every task. Others are written first,
    since a number made while reading would change with the cluster.
    """
    name = "row"
    while name in (c.lower() for c in df.columns):
        name += "_"
    if _plain_scan(df):
        file, place = (f"_{name}_{x}" for x in ("file", "place"))
        rows = df.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(place))
        files = stored(rows.select(file).distinct(), "files")
        if files.count() <= FILES:
            number = files.select(file, (F.row_number().over(Window.orderBy(file)) * F.lit(1 << 32)).alias(name))
            return rows.join(F.broadcast(number), file).withColumn(name, F.col(name) + F.col(place)).select(*df.columns, name), name
    return stored(df.withColumn(name, F.monotonically_increasing_id()), "rows"), name
