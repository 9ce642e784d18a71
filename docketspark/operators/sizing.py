"""Checks of size before a broadcast."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes of files behind what one task sorts: text boxes take some 20 times their bytes in a file
TASK_BYTES = 2 << 20
#: rows of a narrow table (about 100 bytes each) that may be broadcast
MAX_BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; on one machine without one, as in tests, a new one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return named or tempfile.mkdtemp(prefix="spark-checkpoint-")


def materialize(df: DataFrame) -> DataFrame:
    """The same rows, read from the shared folder: what depends on their partitions is worked out once."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the table has at most max_rows rows; beyond that the join shuffles."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def cores(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism


def parts(df: DataFrame) -> int:
    """How many tasks are to share the rows, so that what one holds does not grow with the input: by the bytes of the files behind them, and as many as a shuffle has at least."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(n for n in sizes if n < 1 << 50)  # Spark gives a huge size where it knows none
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), known // TASK_BYTES)
