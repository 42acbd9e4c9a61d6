"""Writers of state: event log, SARIF, content-addressed shards, ordered publishing, upserts, pruned tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.graph import cut

#: Fixed: the names that an event may have.
EVENTS = (
    "ScanStarted", "SymbolIndexed", "EvidencePacketBuilt", "LLMCallGated", "SARIFEmitted", "ScanCompleted", "InvalidationComputed", "PriorityScored", "FindingDeduped", "DedupEmbeddingTierStatus",
    "ClusterStorePersisted", "AdapterRegistered", "AdapterPrecisionUnavailable", "LanguageShardPersisted",
)


def append_events(events: DataFrame, path: str) -> None:
    """Append events (event, at, event_id, payload) as JSON lines; an unknown name stops the write."""
    checked = events.withColumn("event", F.when(F.col("event").isin(*EVENTS), F.col("event")).otherwise(F.raise_error(F.concat(F.lit("unknown event: "), F.coalesce("event", F.lit("NULL"))))))
    checked.select("event", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"), "event_id", "payload").write.mode("append").json(path)


def sarif_results_json(results: DataFrame) -> DataFrame:
    """Rows (rule_id, level, message, uri, start_line) as SARIF result objects, one JSON text each, keys sorted."""
    place = F.struct(F.struct(F.struct(F.col("uri").alias("uri")).alias("artifactLocation"), F.struct(F.col("start_line").alias("startLine")).alias("region")).alias("physicalLocation"))
    return results.select(F.to_json(F.struct("level", F.array(place).alias("locations"), F.struct(F.col("message").alias("text")).alias("message"), F.col("rule_id").alias("ruleId"))).alias("value"))


def write_sarif(results: DataFrame, path: str, tool: str = "quern") -> None:
    """A SARIF 2.1.0 log as a folder of parts that concatenate to one document: head, results by lines, tail.

    Nothing is gathered to the driver: the results are written by their own tasks, each line led by a comma but for the
    first, and the names of the parts sort in the order of the document.
    """
    head = json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0"})[:-1] + ', "runs": [{"tool": {"driver": {"name": ' + json.dumps(tool) + '}}, "results": ['
    spark = results.sparkSession
    write = lambda df, name: df.write.mode("overwrite").text(f"{path}/{name}")
    write(spark.createDataFrame([(head,)], "value string").coalesce(1), "0-head")
    rows = cut(sarif_results_json(results.orderBy("uri", "start_line", "rule_id")).withColumn("n", F.monotonically_increasing_id()))
    first = rows.agg(F.min("n")).first()[0]
    write(rows.select(F.when(F.col("n") == first, F.col("value")).otherwise(F.concat(F.lit(", "), "value")).alias("value")), "1-results")
    write(spark.createDataFrame([("]}]}",)], "value string").coalesce(1), "2-tail")


def write_shards(documents: DataFrame, path: str) -> None:
    """Documents under two levels of their hash, rewriting only the partitions at hand."""
    parts = documents.withColumn("h1", F.substring("hash", 1, 2)).withColumn("h2", F.substring("hash", 3, 2))
    parts.repartition("h1", "h2").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("h1", "h2").parquet(path)


def read_shard(spark: SparkSession, path: str, hash_: str) -> DataFrame:
    """The documents of one hash; only its partition is read."""
    return spark.read.parquet(path).where((F.col("h1") == hash_[:2]) & (F.col("h2") == hash_[2:4]) & (F.col("hash") == hash_)).drop("h1", "h2")


def publish(df: DataFrame, root: str, version: str) -> None:
    """Write a version beside the current one, then point to it: readers see the old one or the new one, whole."""
    df.write.mode("overwrite").parquet(f"{root}/versions/{version}")
    df.sparkSession.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{root}/current")


def published(spark: SparkSession, root: str) -> DataFrame:
    version = spark.read.schema("version string").json(f"{root}/current").first()
    if version is None:
        raise FileNotFoundError(f"nothing is published under {root}")
    return spark.read.parquet(f"{root}/versions/{version[0]}")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The current rows with those of equal keys replaced; of several changes of a key the last by ``seq`` holds."""
    cols = current.columns
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col("seq")).alias("row")).select("row.*")
    return current.join(last, keys, "left_anti").unionByName(last.select(*cols))


def snapshot(df: DataFrame, path: str, scan_id: str) -> None:
    """Keep a state under its scan, beside those of other scans."""
    if not scan_id or len(scan_id) > 128 or not all(c.isalnum() or c in "._-" for c in scan_id):
        raise ValueError("a scan id has 1 to 128 letters, digits, dots, lines and underscores")
    df.withColumn("scan_id", F.lit(scan_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan_id").parquet(path)


def scan_manifest(spark: SparkSession, path: str, scan_id: str, state: str, at: str) -> None:
    """Append that a scan started or completed."""
    if state not in ("started", "completed"):
        raise ValueError("a scan is started or completed")
    spark.createDataFrame([(scan_id, state, at)], "scan_id string, state string, at string").coalesce(1).write.mode("append").json(path)


def suppress(rules: DataFrame, rule: dict[str, str | None], days: int, now: str) -> DataFrame:
    """The suppression rules with one more that ends so many days from now."""
    until = F.date_format(F.lit(now).cast("timestamp") + F.expr(f"interval {int(days)} days"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    one = rules.sparkSession.range(1).select(*[F.lit(rule.get(c)).alias(c) for c in ("finding_id", "category", "path_prefix", "reason")], until.alias("until"))
    return rules.unionByName(one)


def unsuppress(rules: DataFrame, **keys: str | None) -> DataFrame:
    """The rules without those that meet any of the keys given; keys that are NULL or empty meet none."""
    met = F.lit(False)
    for k, v in keys.items():
        if v:
            met = met | F.coalesce(F.col(k) == v, F.lit(False))
    return rules.where(~met)


def clear(df: DataFrame, path: str) -> None:
    """Leave an empty table of the same columns in a table's place."""
    df.limit(0).write.mode("overwrite").parquet(path)


def lookup_symbol(spark: SparkSession, path: str, symbol_id: str, hashes: dict[str, str]) -> DataFrame:
    """One symbol by its id: the path before ``::`` gives the shard's hash, of which only the partition is read."""
    hash_ = hashes.get(symbol_id.split("::", 1)[0])
    shard = read_shard(spark, path, hash_ or "0" * 64)
    return shard.where(F.col("symbol_id") == symbol_id)


def missing_shards(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Hashes that a manifest names and no shard has; a manifest counts only if there are none."""
    return wanted.select("hash").distinct().join(stored.select("hash"), "hash", "left_anti")
