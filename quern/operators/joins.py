"""Joins that Spark has no operator for: as-of, band."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranges of the order column that an as-of join works on by themselves, as days.
SLICE_DAYS = 30


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, id_: str, slice_days: int = SLICE_DAYS) -> DataFrame:
    """(id_, match_key): for each left row the right row with equal keys and the greatest ``at`` strictly below its own
    (the greatest id among equals). Left rows without a match give no row; NULL keys match nothing.

    Both sides are united and walked in order once, so nothing is multiplied. The walk goes by keys and slices of time;
    what a slice inherits is the last right row of the slices before it, found over one row per slice. So a key that
    holds a third of all rows is split into its slices.
    """
    sec = F.unix_micros(F.col(at))
    both = left.select(*keys, sec.alias("t"), F.col(id_).alias("l"), F.lit(None).cast("long").alias("r")).unionAll(right.select(*keys, sec.alias("t"), F.lit(None).cast("long").alias("l"), F.col(id_).alias("r")))
    for k in keys:
        both = both.where(F.col(k).isNotNull())
    both = both.withColumn("slice", F.floor(F.col("t") / (slice_days * 86_400_000_000)))
    last = both.where("r is not null").groupBy(*keys, "slice").agg(F.max(F.struct("t", "r")).alias("last"))
    every = both.select(*keys, "slice").distinct().join(last, [*keys, "slice"], "left")
    before = F.max("last").over(Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    inherited = every.select(*keys, "slice", before.alias("inherited"))
    w = Window.partitionBy(*keys, "slice").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    walked = both.withColumn("own", F.max(F.when(F.col("r").isNotNull(), F.struct("t", "r"))).over(w)).where("l is not null").join(inherited, [*keys, "slice"])
    return walked.select(F.col("l").alias(id_), F.coalesce("own", "inherited")["r"].alias("match_key")).where("match_key is not null")


def band(spots: DataFrame, keys: list[str], value: str, width: int) -> DataFrame:
    """Pairs of spots (keys, value, first_key) with equal keys whose values differ by 1 to ``width``.

    An equi-join on buckets of the width: each spot also asks in the next bucket, where partners above may lie.
    """
    bucket = F.floor(F.col(value) / width)
    a = spots.select(*keys, F.col(value).alias("va"), F.col("first_key").alias("key_a"), F.explode(F.array(bucket, bucket + 1)).alias("b"))
    b = spots.select(*keys, F.col(value).alias("vb"), F.col("first_key").alias("key_b"), bucket.alias("b"))
    j = a.join(b, [*keys, "b"]).where((F.col("vb") > F.col("va")) & (F.col("vb") - F.col("va") <= width))
    return j.select(*keys, F.col("va").alias(f"{value}_a"), F.col("vb").alias(f"{value}_b"), "key_a", "key_b")
