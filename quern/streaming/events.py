"""Structured Streaming over the event log: replay, tumbling and sliding windows, sessions, stateful deduplication."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.operators.graph import shared_folder


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str, checkpoint: str | None = None) -> DataFrame:
    """Run a stream over all that is there (availableNow) and give the rows it put out, read back from files.

    Files and state lie in the shared folder. In the mode complete only the last batch counts; a batch that is run again
    replaces its own files.
    """
    spark = stream.sparkSession
    at = f"{shared_folder(spark)}/stream-{uuid4().hex}"
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/" + ("now" if mode == "complete" else f"batch={number}"))

    w = stream.writeStream.foreachBatch(write).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint or f"{at}/checkpoint")
    w.start().awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{at}/rows")


def sink(stream: DataFrame, path: str, checkpoint: str, also: Callable[[DataFrame, int], None] | None = None):
    """Append a stream to Parquet files, each batch once; ``also`` may write a second copy of a batch."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if also:
            also(batch, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_counts(stream: DataFrame) -> DataFrame:
    """Events per day and type, in tumbling windows of a day."""
    g = stream.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("value"))
    return g.select(F.unix_seconds("window.start").alias("day"), "event_type", "events", "value")


def rolling_counts(stream: DataFrame) -> DataFrame:
    """Events per type in windows of 14 days that start every day."""
    g = stream.withWatermark("ts", "1 day").groupBy(F.window("ts", "14 days", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("events"))
    return g.select(F.unix_seconds("window.start").alias("start"), "event_type", "events")


def sessions(stream: DataFrame) -> DataFrame:
    """Sessions per user: events at most eight hours apart."""
    g = stream.withWatermark("ts", "1 day").groupBy(F.session_window("ts", "8 hours"), "user_id").agg(F.count(F.lit(1)).alias("events"))
    return g.select("user_id", F.unix_micros("session_window.start").alias("start"), "events")


def running_clusters(stream: DataFrame, key: str, at: str = "ts") -> DataFrame:
    """(key, rows, first_seen, last_seen, is_new) per key and batch, carried on in state: an update for each key that a
    batch brings. State has three numbers per key and ends 30 days after the key was last seen."""

    def carry(group, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, first, last = state.get if state.exists else (0, None, None)
        new = not state.exists
        for f in frames:
            t = f["us"]
            n += len(f)
            first = int(t.min()) if first is None else min(first, int(t.min()))
            last = int(t.max()) if last is None else max(last, int(t.max()))
        state.update((n, first, last))
        state.setTimeoutTimestamp(max(last // 1000 + 30 * 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [group[0]], "rows": [n], "first_seen": [first], "last_seen": [last], "is_new": [new]})

    keyed = stream.where(F.col(key).isNotNull()).withWatermark(at, "1 day").select(F.col(key).cast("string").alias("key"), F.unix_micros(at).alias("us"), at)
    return keyed.groupBy("key").applyInPandasWithState(
        carry, "key string, rows long, first_seen long, last_seen long, is_new boolean", "rows long, first_seen long, last_seen long", "update", GroupStateTimeout.EventTimeTimeout
    )


def unique_events(stream: DataFrame) -> DataFrame:
    """Each event id once, over a watermark of 30 days."""
    return stream.withWatermark("ts", "30 days").dropDuplicatesWithinWatermark(["event_id"])


def followed(stream: DataFrame, other: DataFrame, hours: int = 6) -> DataFrame:
    """(user_id, first, later, gap_us): pairs of events of one user and different streams, the second within some hours
    of the first. Both sides are kept in state until no partner can come any more; rows over a day late are dropped."""
    a = stream.withWatermark("ts", "1 day").select(F.col("user_id").alias("user_a"), F.col("event_id").alias("first"), F.col("ts").alias("ts_a"))
    b = other.withWatermark("ts", "1 day").select(F.col("user_id").alias("user_b"), F.col("event_id").alias("later"), F.col("ts").alias("ts_b"))
    near = F.expr(f"user_a = user_b and ts_b > ts_a and ts_b <= ts_a + interval {int(hours)} hours")
    return a.join(b, near).select(F.col("user_a").alias("user_id"), "first", "later", (F.unix_micros("ts_b") - F.unix_micros("ts_a")).alias("gap_us"))


def sweeps(stream: DataFrame, key: str, fresh: str) -> DataFrame:
    """(key, day, mode): whether anything told a day to start afresh, which makes its work a full sweep."""
    g = stream.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day"), key).agg(F.max(F.col(fresh).cast("int")).alias("f"))
    return g.select(key, F.unix_seconds("window.start").alias("day"), F.when(F.col("f") == 1, "sweep").otherwise("bounded").alias("mode"))


def kept(stream: DataFrame, days: int, now: str) -> DataFrame:
    """The rows of a stream that have not expired: at most so many days old at a time given."""
    return stream.where(F.col("ts") >= F.lit(now).cast("timestamp") - F.expr(f"interval {int(days)} days"))
