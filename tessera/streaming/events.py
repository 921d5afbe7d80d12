"""Unbounded tables: windowed counts with watermarks, sessions, change detection, expiring caches and micro-batch ingest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.cluster import shipped


def windowed(events: DataFrame, width: str, slide: str | None = None, late: str = "1 hour", time: str = "ts", by: list[str] | None = None) -> DataFrame:
    """Counts and sums of `value` in tumbling or sliding windows; the same on a stream and on a table."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    span = F.window(time, width, slide) if slide else F.window(time, width)
    out = rows.groupBy(span.alias("w"), *(by or [])).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *(by or []), "n", "total")


def sessions(events: DataFrame, gap: str, key: str, late: str = "1 hour", time: str = "ts") -> DataFrame:
    """Runs of a key's events with less than `gap` between them."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def first_of(events: DataFrame, keys: list[str], late: str = "1 hour", time: str = "ts") -> DataFrame:
    """The first row of each key that arrives, forgetting keys that the watermark has passed."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def unexpired(events: DataFrame, key: str, seconds: int, time: str = "ts") -> DataFrame:
    """(key, cached) for every event of a stream: whether one of its key came within `seconds` before it."""

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        if state.hasTimedOut:
            state.remove()
            return
        times = sorted(t.timestamp() for b in batches for t in b[time])
        out = []
        for t in times:
            hit = last is not None and t - last <= seconds
            out.append((name[0], hit))
            last = last if hit else t
        state.update((last,))
        state.setTimeoutTimestamp(max(int((last + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "cached"])

    shipped(events.sparkSession)
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(F.col(key).alias("key"), time).withWatermark(time, "1 hour")
    return rows.groupBy("key").applyInPandasWithState(run, f"key {kind}, cached boolean", "last double", "append", GroupStateTimeout.EventTimeTimeout)


def ingest_stream(spark: SparkSession, folder: str, schema: str, save: Callable[[DataFrame, int], None], checkpoint: str, kind: str = "parquet", files_per_batch: int = 100) -> StreamingQuery:
    """Feeds files that appear in a folder to `save`, batch by batch, until none are left; progress survives restarts."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(kind).load(folder)
    return rows.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changed_only(batch: DataFrame, known: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows of a batch whose digest differs from what is known of their key."""
    return batch.join(known.select(key, digest).distinct(), [key, digest], "left_anti")


def expiry(time: Column, seconds: int) -> Column:
    return F.timestamp_seconds(F.unix_micros(time) / 1_000_000 + seconds)
