"""Streams: packages indexed as they arrive, and windowed counts of events with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from floorgraph.sources import packages


def index_arrivals(spark: SparkSession, landing: str, index_root: str, checkpoint: str) -> StreamingQuery:
    """Index the packages below ``landing`` whose metadata file is new, then stop; a rerun takes what came since.

    A batch reads the folders of its own packages and overwrites their partitions only, so its work goes by what
    arrived, and repeating it after a failure changes nothing.
    """
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "metadata.json").load(landing)
    arrivals = files.select(F.regexp_replace(packages.decoded(F.col("_metadata.file_path")), "/[^/]*$", "").alias("folder"))

    def index(batch: DataFrame, _: int) -> None:
        folders = sorted(r["folder"] for r in batch.distinct().collect())  # the names that the stream's log holds as well
        if folders:
            packages.write_index(packages.index_tables(packages.read_packages(batch.sparkSession, folders)), index_root)

    return arrivals.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "30 minutes") -> DataFrame:
    """Events and their mean value by time window and type; rows later than the watermark allows are left out."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    slot = F.window("ts", window, slide) if slide else F.window("ts", window)
    grouped = events.withWatermark("ts", late).groupBy(slot.alias("slot"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("slot.start").alias("start"), F.col("slot.end").alias("end"), "event_type", "n", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "30 minutes") -> DataFrame:
    """Events of a user between pauses of at least ``gap``."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("slot"), "user_id")
    return grouped.agg(F.count("*").alias("n")).select("user_id", F.col("slot.start").alias("start"), F.col("slot.end").alias("end"), "n")


def event_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
