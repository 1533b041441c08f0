"""Arriving files as a stream: each micro-batch's new files get their kind and facts and are appended to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mediafold.sources.listing import with_kind

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of path, header, bytes, mtime, sha256, mime and type."""
    raw = spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").load(folder)
    facts = raw.select(
        "path", F.substring("content", 1, 32).alias("header"), F.col("length").alias("bytes"), F.unix_timestamp("modificationTime").alias("mtime"), F.sha2("content", 256).alias("sha256"),
    )
    return with_kind(facts)


def append_facts(stream: DataFrame, table_path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends to a Parquet table, each file once; the file sink's log makes it exact."""
    writer = stream.drop("header").writeStream.format("parquet").option("path", table_path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def counts_by_kind(stream: DataFrame, delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Files and bytes by kind and window of their modification time; late files count while the watermark allows."""
    timed = stream.withColumn("at", F.timestamp_seconds("mtime")).withWatermark("at", delay)
    return timed.groupBy(F.window("at", window), "type").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))
