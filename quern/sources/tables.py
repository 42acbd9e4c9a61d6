"""Reading the tables, and the few views of them that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parse_results with UTF-8 source, and that source as text."""
    return table(spark, sf_dir, "parse_results").where("lines is not null").withColumn("text", F.array_join("lines", "\n"))
