"""The folder that driver and executors share, and lineage cuts into it."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

#: Rows up to which a side of a join may be sent to all tasks, as keys and a label of two fields each a hash table of about 20 MB.
SENT = 50_000


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session without one, as in tests, gets a folder of its own."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='floorgraph-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one, not made yet."""
    return f"{shared_dir(spark)}/{name}-{uuid4().hex}"


def dealt(df: DataFrame, *by: str, rows: int | None = None) -> DataFrame:
    """``df`` dealt by columns to a few tasks a core: few bytes come as one task, whatever work each row makes.

    With ``rows``, to so many tasks that each has about as many at most, whose work a task must hold.  A number of its own is not coalesced.
    """
    spark = df.sparkSession
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(max(tasks, -(-df.count() // rows) if rows else 1), *by)


def unsent(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` as a side of a join that meets the other one by a merge if it has many rows: ``rows`` at most, or as counted.

    Spark's rule goes by the bytes of files; ten MB of packed keys may be millions of rows, which would pass through the driver.
    """
    return df.hint("merge") if (df.count() if rows is None else rows) > SENT else df


def stored(df: DataFrame, folder: str) -> DataFrame:
    """``df`` written to ``folder`` and read again: unlike a checkpoint's, the size of files tells Spark which side of a join is small."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def cut(df: DataFrame) -> DataFrame:
    """What was computed, written to the shared folder and read again, however it came about.

    A checkpoint would keep the plan's estimated size, the product of all sizes joined so far: in
    rounds that is a number with exponentially many digits, which fills the driver.
    """
    return stored(df, new_folder(df.sparkSession, "cut"))
