"""Ranking operators: top-k with a diversity quota, Gini index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def topk_with_quota(df: DataFrame, group: list[str], key: list[str], k: int, first: list[Column], rest: list[Column]) -> DataFrame:
    """k rows per group: k - min(2, k div 2) by the first order, the others from what remains by the second.

    ``key`` names a row within its group. Adds chosen_by (priority or diversity) and place. Both orders must be total, so
    that ties cannot vary. Each window is limited right away, which Spark does before the shuffle, so that a hot group
    sends a few rows per task and no task sorts it whole.
    """
    reserved = min(2, k // 2)
    w = Window.partitionBy(*group)
    top = df.withColumn("place", F.row_number().over(w.orderBy(*first))).where(F.col("place") <= k - reserved)
    left = df.join(top.select(*group, *key), [*group, *key], "left_anti")
    others = left.withColumn("place", F.row_number().over(w.orderBy(*rest))).where(F.col("place") <= reserved)
    return top.withColumn("chosen_by", F.lit("priority")).unionByName(others.withColumn("chosen_by", F.lit("diversity")))


def gini(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """The Gini index of non-negative values per group: 2 sum(i x) / (n sum(x)) - (n + 1) / n, rounded to 6 places.

    Equal values are counted first: a run of m equal values from place p on adds x (m p + m (m - 1) / 2). So a group's
    window holds its distinct values only. 0 where all values are 0.
    """
    runs = df.groupBy(*group, F.col(value).alias("x_")).agg(F.count(F.lit(1)).alias("m_"))
    before = F.coalesce(F.sum("m_").over(Window.partitionBy(*group).orderBy("x_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumn("p_", before + 1)
    x, m, p = F.col("x_"), F.col("m_"), F.col("p_")
    s = runs.groupBy(*group).agg(F.sum(x * (m * p + m * (m - 1) / 2)).alias("ix"), F.sum(x * m).alias("sx"), F.sum("m_").alias("n"))
    g = 2.0 * F.col("ix") / (F.col("n") * F.col("sx")) - (F.col("n") + 1.0) / F.col("n")
    return s.select(*group, F.when(F.col("sx") > 0, F.round(F.greatest(F.lit(0.0), g), 6)).otherwise(0.0).alias("gini"))
