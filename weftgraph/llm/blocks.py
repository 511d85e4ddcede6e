"""Documents dealt into blocks of some megabytes, and answers brought back to them.

A corpus-wide statistic is gathered in two steps: each block sends what it needs to know,
once whatever the number of its documents, and the answers meet the block's texts again.
A block is a function of the row, so that a rerun makes the same blocks.
"""

from __future__ import annotations

import gc
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 2 << 20
#: What a row counts besides its text, so that many empty texts make many blocks.
_ROW = 64


def blocked(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows(id, text, ...) with a block number, and the number of blocks."""
    total = rows.agg(F.sum(F.octet_length("text") + F.lit(_ROW))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    return rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int")), n


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of finished steps, which wait for the driver's garbage collection.

    The first round frees what holds the shuffles, the second the shuffles.
    """
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
