"""Incremental ingestion of answers and event-time windows, by Structured Streaming."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwright.sources.ingest import parse_answers


def answer_stream(spark: SparkSession, path: str) -> DataFrame:
    """Answer files as they land, parsed and validated, with the time of their file."""
    text = spark.readStream.option("wholetext", "true").text(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1)
    raw = text.select(name.alias("job_id"), F.col("value").alias("raw"), F.col("_metadata.file_modification_time").alias("landed_at"))
    return parse_answers(raw.filter("job_id <> ''"), keep=("landed_at",))


def collect_available(spark: SparkSession, path: str, target: str, checkpoint: str) -> int:
    """Adds the valid answers among all new files to ``target`` and stops; invalid ones stay pending. Returns how many files were new.

    Each micro-batch is a folder of its own that a repeated batch overwrites, so nothing is added twice.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.filter("valid").write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = answer_stream(spark, path).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def collect_until_quiet(spark: SparkSession, path: str, target: str, checkpoint: str, quiet: int = 3, every: float = 60.0, rounds: int = 60) -> int:
    """Collects every so many seconds until ``quiet`` rounds in a row brought nothing, or all rounds are over; returns the rounds taken."""
    still = 0
    for n in range(1, rounds + 1):
        still = still + 1 if collect_available(spark, path, target, checkpoint) == 0 else 0
        if still >= quiet:
            return n
        time.sleep(every)
    return rounds


def latest_answers(spark: SparkSession, target: str) -> DataFrame:
    """Per job the answer whose file landed last; of files of one time that of the later batch."""
    found = spark.read.parquet(target)
    columns = [c for c in found.columns if c not in ("job_id", "batch")]
    last = F.max_by(F.struct(*columns), F.struct("landed_at", "batch"))
    return found.groupBy("job_id").agg(last.alias("a")).select("job_id", "a.*")


def tumbling(events: DataFrame, every: str = "1 hour", lateness: str = "2 hours", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and sums per window and key; on a stream, windows close when the watermark passes them."""
    timed = events.withWatermark("ts", lateness) if events.isStreaming else events
    out = timed.groupBy(F.window("ts", every).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "2 hours", key: str = "user_id") -> DataFrame:
    timed = events.withWatermark("ts", lateness) if events.isStreaming else events
    out = timed.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
