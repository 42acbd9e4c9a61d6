"""Operators on edge tables: bounded closure, centrality, reverse references, incremental maintenance."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. One of this machine is taken only where none is named and all runs
    on this machine, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("name a shared folder in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quern-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def clean_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct (caller, callee) without self calls, both ends known."""
    known = symbols.where("symbol_id is not null").select("symbol_id").distinct()
    e = edges.where("caller <> callee").select("caller", "callee").distinct()
    return e.join(known, e.callee == known.symbol_id, "left_semi").join(known, e.caller == known.symbol_id, "left_semi")


def callers_within(edges: DataFrame, seeds: DataFrame, depth: int, key: str = "seed") -> DataFrame:
    """(key, symbol_id, depth) of the callers reached from each seed in at most ``depth`` steps, the seed excluded.

    ``seeds`` has (key, symbol_id). Each level joins the last frontier with the edges and drops what was met before;
    the frontier is cut at every level so that plans stay flat. Cycles end by themselves.
    """
    met = seeds.select(key, "symbol_id").distinct().withColumn("depth", F.lit(0))
    front = met
    for d in range(1, depth + 1):
        step = front.join(edges, front.symbol_id == edges.callee).select(key, F.col("caller").alias("symbol_id")).distinct()
        front = cut(step.join(met, [key, "symbol_id"], "left_anti").withColumn("depth", F.lit(d)))
        met = met.union(front)
    return met.where("depth > 0")


def near_callers(edges: DataFrame) -> DataFrame:
    """(symbol_id, callers): how many distinct symbols call a symbol in one step or in two, itself not counted.

    Only the distinct pairs are shuffled, and counted where they lie: nothing is stored between the steps. A hub's
    callers are spread over its callers' callers in the join, which Spark splits where they are skewed.
    """
    one = edges.select(F.col("callee").alias("symbol_id"), "caller")
    two = one.select("symbol_id", F.col("caller").alias("via")).join(edges.select(F.col("callee").alias("via"), "caller").hint("merge"), "via").select("symbol_id", "caller")
    return one.union(two).where("caller <> symbol_id").distinct().groupBy("symbol_id").agg(F.count(F.lit(1)).alias("callers"))


def degrees(edges: DataFrame) -> DataFrame:
    """(symbol_id, degree): the number of distinct edges at either end."""
    ends = edges.select(F.col("caller").alias("symbol_id")).union(edges.select(F.col("callee").alias("symbol_id")))
    return ends.groupBy("symbol_id").agg(F.count(F.lit(1)).alias("degree"))


def tiers(df: DataFrame, value: str) -> DataFrame:
    """tier (high, medium, low) by the quartiles at index n div 4 and 3n div 4; with under 4 rows, by least and most."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("n_"))
    upto = counts.withColumn("upto_", F.sum("n_").over(Window.orderBy(value)))
    total = counts.agg(F.sum("n_").alias("n"))
    at = lambda k: F.min(F.when(F.col("upto_") > k, F.col(value)))
    n = F.col("n")
    q = upto.crossJoin(F.broadcast(total)).groupBy().agg(
        F.when(F.max(n) < 4, F.min(value)).otherwise(at(F.floor(n / 4))).alias("q1"), F.when(F.max(n) < 4, F.max(value)).otherwise(at(F.floor(n * 3 / 4))).alias("q3")
    )
    return df.crossJoin(F.broadcast(q)).withColumn("tier", F.when(F.col(value) >= F.col("q3"), "high").when(F.col(value) <= F.col("q1"), "low").otherwise("medium")).drop("q1", "q3")


def snapshot_diff(before: DataFrame, now: DataFrame, key: list[str], value: str) -> DataFrame:
    """key, state (added, deleted, dirty, same) of two snapshots, NULL-safe."""
    a, b = before.select(*key, F.col(value).alias("old"), F.lit(1).alias("in_old")), now.select(*key, F.col(value).alias("new"), F.lit(1).alias("in_new"))
    state = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "deleted").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("dirty")
    return a.join(b, key, "full_outer").select(*key, state.alias("state"))
