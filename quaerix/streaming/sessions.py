"""Sliding sessions over event streams, and in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaerix.operators.catalog import TTL_MINUTES


def session_windows(events: DataFrame, minutes: int = TTL_MINUTES, key: str = "user_id", at: str = "ts") -> DataFrame:
    """(key, started_at, expires_at, n_events): a session lasts until *minutes* after its last event.

    The same plan serves a table and a stream; a stream needs a watermark on *at* to close its sessions.
    """
    grouped = events.groupBy(key, F.session_window(F.col(at), f"{minutes} minutes").alias("w")).agg(F.count("*").alias("n_events"))
    return grouped.select(key, F.col("w.start").alias("started_at"), F.col("w.end").alias("expires_at"), "n_events")


def stream_sessions(events: DataFrame, late: str = "10 minutes", minutes: int = TTL_MINUTES, key: str = "user_id", at: str = "ts") -> DataFrame:
    """`session_windows` of a stream whose events may be *late*; write it in append mode."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    return session_windows(timed.withWatermark(at, late), minutes, key, at)


def latest_chunks(spark: SparkSession, path: str) -> DataFrame:
    """What `ingest_chunks` has written, without the chunks of files that a later batch brought again."""
    every = spark.read.parquet(path)
    last = every.groupBy("repository", "file_path").agg(F.max("batch").alias("batch"))
    return every.join(last, ["repository", "file_path", "batch"], "left_semi").drop("batch")


def ingest_chunks(files: DataFrame, path: str, checkpoint: str):
    """Chunk a stream of files (repository, file_path, content) into a table by batch and repository, exactly once for each batch.

    A file may come again with other contents: `latest_chunks` reads its last version.
    """
    from quaerix.operators.chunking import chunk_files

    def write(batch: DataFrame, number: int) -> None:
        chunk_files(batch).write.mode("overwrite").partitionBy("repository").parquet(f"{path}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
