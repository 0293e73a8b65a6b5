"""The refresh loop as a stream: new files are read, changed documents replaced."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def refresh(spark: SparkSession, folder: str, schema: str, state: str, checkpoint: str, apply: Callable[[DataFrame], None] | None = None, interval: str | None = None):
    """Starts a query over Parquet files (source_id, content, ...) that arrive in a folder.

    Each batch keeps the last row of a source, drops those whose content hash is
    the stored one, upserts the state table and hands the changed rows to
    ``apply``.  A batch that runs again upserts the same rows.  Without an
    interval it takes what is there and ends.
    """
    from folia.operators import store

    def batch(df: DataFrame, number: int) -> None:
        rows = df.withColumn("content_hash", F.md5(F.coalesce("content", F.lit(""))))
        rows = rows.groupBy("source_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "source_id"]), F.struct("version", "content_hash")).alias("r")).select("source_id", "r.*")
        old = store.current(spark, state, "sources")
        old = rows.limit(0) if old is None else old
        changed = rows.join(old.select("source_id", F.col("content_hash").alias("h")), "source_id", "left").where("h is null or h <> content_hash").drop("h")
        store.swap(store.upsert(old, changed, "source_id"), state, "sources")
        if apply:
            apply(changed)

    stream = spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (stream.trigger(processingTime=interval) if interval else stream.trigger(availableNow=True)).start()


def windowed_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Counts per window and kind of a stream or table; a stream drops rows later than the watermark."""
    if events.isStreaming:
        events = events.withWatermark(ts, lateness)
    return events.groupBy(F.window(ts, window).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")
