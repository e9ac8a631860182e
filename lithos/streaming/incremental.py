"""Incremental import: new files since the last run, by a checkpointed stream or by an anti-join."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.operators.dedup import not_yet_done
from lithos.sources.files import decoded, read_trees, routed


def session_name(roots: list[str], target: str) -> str:
    """The same for the same roots in any order: names the checkpoint of a resumable run."""
    return sha256("\n".join([*sorted(roots), target]).encode()).hexdigest()[:16]


def decode_stream(spark: SparkSession, root: str, target: str, checkpoint: str, per_trigger: int = 4096):
    """Decodes files that arrived since the last run and appends their rows to ``target``.

    A stopped run goes on where it was: offsets and commits are in the checkpoint.
    ``maxFilesPerTrigger`` bounds what is in flight.  Spark's file source passes over names
    that begin with "." or "_"; use resume() where those matter.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(root)
    rows = decoded(routed(files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length", "content")))
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", f"{checkpoint}/{session_name([root], target)}").trigger(availableNow=True).start()


def resume(spark: SparkSession, roots: list[str], done: DataFrame | None) -> DataFrame:
    """Entry rows of the files below the roots that ``done`` (path) does not list yet; hidden files included."""
    files = routed(read_trees(spark, roots))
    return decoded(files if done is None else not_yet_done(files, done, "path"))


def windowed_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts by event-time window, for batch and stream alike; late rows beyond the watermark go in a stream."""
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    return events.groupBy(F.window(ts, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")
