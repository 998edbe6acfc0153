"""Streaming ingest: files to chunks with incremental dedup, and event windows with watermarks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_table(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream; new files are found as they come, so many for each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(path)


def run_once(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Process all there is, exactly once, to Parquet; a second call takes up what came since."""
    query = transform(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()


def new_contents(stream: DataFrame, content: str = "content", time: str | None = None, forget: str | None = None) -> DataFrame:
    """Rows whose content hash wasn't met before (keyed state).

    Without `forget` every hash is kept for ever. With it (an interval such as "30 days", and `time`, the row's
    timestamp) a hash is forgotten that long after the time of the row that brought it, as soon as the stream's watermark
    is past that, so state holds the hashes of one interval; a content that comes after that counts as new. Rows
    older than the watermark, the latest time so far less `forget`, are dropped. A null content is a content of its own;
    a row without a time is never late, and its hash is forgotten after its batch.
    """
    if (time is None) != (forget is None):
        raise ValueError("time and forget go together")
    hashed = stream.withColumn("content_hash", F.sha2(F.col(content), 256))
    if forget is None:
        return hashed.dropDuplicates(["content_hash"])
    return hashed.withWatermark(time, forget).dropDuplicatesWithinWatermark(["content_hash"])


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums by event type and window; late rows beyond the watermark are dropped."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return timed.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions by user: a gap of inactivity closes one."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
