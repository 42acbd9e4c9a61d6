"""Pieces shared by the operators of this subpackage: reading, lineage cuts, hashing of token sets."""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session; a folder of this machine is taken only where none is named and
    all runs on this machine, as in tests.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("name a shared folder in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quern-"))
    return df.checkpoint()


def tidy(c: Column) -> Column:
    """Lower case, outer blanks (any white space) removed; NULL stays NULL."""
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def extension(path: Column) -> Column:
    """The lower-cased extension with its dot, '' if the last path segment has none, NULL for NULL."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def mix(h: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser: another, independent-looking hash of each hash."""
    with np.errstate(over="ignore"):
        x = h ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)
