"""Queries that run as streams, drained with availableNow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.streaming import events as E


def event_log_replay(spark: SparkSession, d: str) -> DataFrame:
    s = E.unique_events(E.replay(spark, d)).select("event_id", "event_type", "user_id", F.get_json_object("props", "$.k").alias("k"))
    return E.drained(s, "append")


def daily_event_counts(spark: SparkSession, d: str) -> DataFrame:
    return E.drained(E.daily_counts(E.replay(spark, d)), "complete")


def rolling_event_counts(spark: SparkSession, d: str) -> DataFrame:
    return E.drained(E.rolling_counts(E.replay(spark, d)), "complete")


def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    return E.drained(E.sessions(E.replay(spark, d)), "complete")


def running_user_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Rows, first and last sight per event type, carried in the state of the stream."""
    return E.drained(E.running_clusters(E.replay(spark, d), "event_type"), "update")


def events_after(spark: SparkSession, d: str) -> DataFrame:
    """Events of the last type by name at most six hours after one of the first of the same user: two streams joined."""
    r = spark.read.parquet(f"{d}/events.parquet").agg(F.min("event_type").alias("a"), F.max("event_type").alias("b")).first()
    return E.drained(E.followed(E.replay(spark, d).where(F.col("event_type") == r.a), E.replay(spark, d).where(F.col("event_type") == r.b)), "append")


def fresh_days(spark: SparkSession, d: str) -> DataFrame:
    """Per repository and day of changesets whether the day is a sweep; changesets are read as a stream."""
    schema = spark.read.parquet(f"{d}/changesets.parquet").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/changesets.parquet*").withColumn("ts", F.col("created_at").cast("timestamp"))
    return E.drained(E.sweeps(s.where("ts is not null"), "repo_id", "is_fresh_instance"), "complete")


def unexpired_events(spark: SparkSession, d: str) -> DataFrame:
    """Events of the 21 days before a time."""
    return E.drained(E.kept(E.replay(spark, d), 21, "2024-01-31").select("event_id", "event_type"), "append")


QUERIES = {f.__name__: f for f in (event_log_replay, daily_event_counts, rolling_event_counts, user_sessions, running_user_clusters, events_after, fresh_days, unexpired_events)}

SQL = {
    "events_after": "WITH k AS (SELECT min(event_type) AS a, max(event_type) AS b FROM events), a AS (SELECT e.* FROM events e, k WHERE event_type = k.a), b AS (SELECT e.* FROM events e, k WHERE event_type = k.b) "
    "SELECT a.user_id, a.event_id AS first, b.event_id AS later, epoch_us(b.ts) - epoch_us(a.ts) AS gap_us FROM a JOIN b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR",
    "fresh_days": "SELECT repo_id, epoch_us(created_at) // 86400000000 * 86400 AS day, CASE WHEN max(is_fresh_instance::int) = 1 THEN 'sweep' ELSE 'bounded' END AS mode FROM changesets WHERE created_at IS NOT NULL GROUP BY 1, 2",
    "unexpired_events": "SELECT event_id, event_type FROM events WHERE epoch_us(ts) >= epoch_us(TIMESTAMP '2024-01-31') - 21 * 86400000000",
    "event_log_replay": "SELECT event_id, event_type, user_id, json_extract_string(props, '$.k') AS k FROM events",
    "daily_event_counts": "SELECT epoch_us(ts) // 86400000000 * 86400 AS day, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
    "rolling_event_counts": "SELECT (epoch_us(ts) // 86400000000 - k) * 86400 AS start, event_type, count(*) AS events FROM events, range(0, 14) r(k) GROUP BY 1, 2",
    "running_user_clusters": "SELECT event_type AS key, count(*) AS rows, epoch_us(min(ts)) AS first_seen, epoch_us(max(ts)) AS last_seen, true AS is_new FROM events WHERE event_type IS NOT NULL GROUP BY 1",
    "user_sessions": "WITH e AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 28800000000 THEN 0 ELSE 1 END AS n FROM events), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM e) "
    "SELECT user_id, min(t) AS start, count(*) AS events FROM s GROUP BY user_id, g",
}
