"""Helpers shared by the corpus operators: tables, shared storage, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the operators' word and line contracts name it.
ASCII_SPACE = "\t\n\x0b\x0c\r "
#: Bytes of rows in one Arrow batch, which a task's JVM and its Python worker hold at once.
BATCH_BYTES = 8 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without one, as in tests, gets a folder of its own;
    on a cluster the executors would not see it, so there its lack is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='floorgraph-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: rows in the shared folder, lineage dropped."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read back by its schema."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_BYTES`` from now on in this session, unless it asks for fewer.

    The registered queries and the pipeline's stages call it; the operators
    leave the session's options as they are (Spark's own bound is 64 MiB).
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(name).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, for tasks that read or write binary files."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def ascii_lower(col: Column) -> Column:
    """A-Z to lower case, all else untouched."""
    return F.translate(col, _UPPER, _LOWER)


def utf8_bytes(col: Column) -> Column:
    return F.coalesce(F.octet_length(col), F.lit(0)).cast("long")
