"""Micro-batch ingest: files as exactly-once units, idempotent batches, expiry of quiet clusters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unit_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_batch: int = 24) -> DataFrame:
    """A stream of new files; the checkpoint remembers which were taken, so a unit is read once and late files are still found."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def write_batches(stream: DataFrame, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None):
    """Append each micro-batch below ``target`` in a folder of its own: a repeated batch overwrites itself and adds nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        (transform(batch) if transform else batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedupe(stream: DataFrame, key: list[str], at: str, delay: str | None = None) -> DataFrame:
    """First sighting of each key, forever; with ``delay`` only within the watermark, which bounds the state (a key may then return)."""
    return stream.dropDuplicates(key) if delay is None else stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(key)


def window_counts(stream: DataFrame, at: str, key: str, width: str = "15 minutes", delay: str = "1 hour") -> DataFrame:
    """Sightings by key and quarter-hour."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, width), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def interval_join(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, hours: int, delay: str = "1 hour") -> DataFrame:
    """Watermarked stream-stream join within ``hours``; both sides' state is dropped once it can no longer match."""
    a, b = left.withWatermark(left_at, delay), right.withColumnRenamed(key, "__key").withWatermark(right_at, delay)
    width = F.expr(f"INTERVAL {hours} HOURS")
    near: Column = (F.col(right_at) >= F.col(left_at) - width) & (F.col(right_at) <= F.col(left_at) + width)
    return a.join(b, (a[key] == b["__key"]) & near).drop("__key")


_STATE = T.StructType([T.StructField("last_us", T.LongType()), T.StructField("n", T.LongType())])


def cluster_activity(stream: DataFrame, key: str, at: str, closed_hours: int = 72, delay: str = "1 hour") -> DataFrame:
    """(key, members, last_us, status): open clusters as they grow, and "closed" once they were quiet for ``closed_hours`` of event time.

    A custom timer per cluster: what a session window cannot give, as open clusters must be reported before they close.
    """
    out = T.StructType([T.StructField(key, stream.schema[key].dataType), T.StructField("members", T.LongType()), T.StructField("last_us", T.LongType()), T.StructField("status", T.StringType())])

    def step(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, n = state.get
            state.remove()
            yield pd.DataFrame([(group[0], n, last, "closed")], columns=out.names)
            return
        last, n = state.get if state.exists else (0, 0)
        for pdf in batches:
            n += len(pdf)
            last = max(last, int(pdf["at_us"].max()))
        state.update((last, n))
        state.setTimeoutTimestamp(max(last // 1000 + closed_hours * 3_600_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(group[0], n, last, "open")], columns=out.names)

    timed = stream.withWatermark(at, delay).withColumn("at_us", F.unix_micros(at))
    return timed.groupBy(key).applyInPandasWithState(step, out, _STATE, "update", "EventTimeTimeout")
