"""Overlapping line chunks of files, and evenly spaced samples of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def line_chunks(files: DataFrame, size: int = 200, overlap: int = 40, threshold: int = 260) -> DataFrame:
    """(file_id, n) to (file_id, chunk_no, first_line, last_line); files up to ``threshold`` lines are one chunk."""
    step = size - overlap
    n = F.col("n")
    count = F.when(n <= threshold, 1).otherwise(F.ceil((n - size) / step) + 1).cast("int")
    c = files.where("n > 0").select("file_id", "n", F.explode(F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).alias("chunk_no"))
    first = (F.col("chunk_no") - 1) * step + 1
    return c.select("file_id", "chunk_no", first.alias("first_line"), F.when(n <= threshold, n).otherwise(F.least(n, first + size - 1)).alias("last_line"))


def sample_even(chunks: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """At most ``most`` rows per key at evenly spaced places of the order, first and last included (half to even)."""
    w = Window.partitionBy(key)
    numbered = chunks.withColumn("i_", F.row_number().over(w.orderBy(order)) - 1).withColumn("m_", F.count(F.lit(1)).over(w))
    places = F.array(*[F.bround((F.col("m_") - 1) * k / F.lit(float(most - 1)), 0).cast("int") for k in range(most)])
    return numbered.where((F.col("m_") <= most) | F.array_contains(places, F.col("i_"))).drop("i_", "m_")
