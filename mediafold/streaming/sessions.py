"""Sessions of a stream: repeated rows dropped within the watermark, session windows, and an upsert that a repeated micro-batch doesn't change.

A row that comes again within the delay counts once. A session is emitted when the watermark has passed its end; rows later than that are dropped and counted by the
engine (``late_rows``). Each micro-batch is written to a folder of its own number, over what a failed try of the same batch has left, so every batch counts once; of rows with the
same keys that of the latest batch is the table's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LOCAL_MERGE = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def sessions(stream: DataFrame, key: str, time: str, id_cols: Sequence[str], gap: str, delay: str, measures: Sequence[Column]) -> DataFrame:
    """``key``, start, end (of the last row, plus the gap), n and the measures of each session."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    once = timed.dropDuplicatesWithinWatermark(list(id_cols)) if stream.isStreaming else timed.dropDuplicates(list(id_cols))
    grouped = once.groupBy(F.session_window(time, gap).alias("session"), key).agg(F.count(F.lit(1)).alias("n"), *measures)
    return grouped.select(key, F.col("session.start").alias("start"), F.col("session.end").alias("end"), *(c for c in grouped.columns if c not in ("session", key)))


def upsert(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what is there now, in micro-batches, each to its own folder of the table."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The table that ``upsert`` writes: of each key the row of the greatest batch."""
    rows = spark.read.parquet(path)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), "batch").alias("row"))
    return last.select("row.*").drop("batch")


def late_rows(query: StreamingQuery) -> int:
    """How many rows came after the watermark, as far as the session remembers the query's batches."""
    return sum(int(o.numRowsDroppedByWatermark) for p in query.recentProgress for o in p.stateOperators)
