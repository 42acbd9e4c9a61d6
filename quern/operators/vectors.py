"""Operators on vectors and signatures: nearest neighbours, centroids, SimHash, Hamming joins."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.operators.graph import cut


def centroids(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, pos, mean): the element-wise mean per label, one row per element; sums are partial before the shuffle."""
    each = vectors.select(label, F.posexplode(vector).alias("pos", "x"))
    return each.groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def centroid_vectors(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, centroid) with the means gathered to an array of the vectors' length."""
    rows = centroids(vectors, label, vector).groupBy(label).agg(F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("c"))
    return rows.select(label, F.transform("c", lambda x: x["mean"]).alias("centroid"))


def nearest(queries: DataFrame, targets: DataFrame, k: int, most: int = 50_000) -> DataFrame:
    """(qid, id, similarity, place): the k targets of greatest cosine for each query, ties by lower id.

    Both have (id, v). A stated query set against all rows, in blocks of about ``most`` queries: a block at a time is
    sent to the tasks, each keeps k per query of its own rows, and only those are shuffled. A zero vector has
    similarity 0 to all; a query is not its own neighbour.
    """
    blocks = max(1, -(-queries.count() // most))
    number = F.pmod(F.xxhash64("id"), F.lit(blocks))
    parts = [_nearest_block(queries.where(number == i), targets, k, keep=blocks > 1) for i in range(blocks)]
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("similarity", 9)), "id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def _nearest_block(queries: DataFrame, targets: DataFrame, k: int, keep: bool) -> DataFrame:
    q = queries.select(F.col("id"), F.transform("v", lambda x: x.cast("double")).alias("v")).toArrow()
    ids = q.column("id").to_numpy()
    m = np.array(q.column("v").to_pylist(), dtype=np.float64)
    size = np.linalg.norm(m, axis=1, keepdims=True) if len(m) else m
    sent = queries.sparkSession.sparkContext.broadcast((ids, np.divide(m, size, out=np.zeros_like(m), where=size > 0) if len(m) else m))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, unit = sent.value
        best: dict[int, list[tuple[float, int]]] = {}
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            tid = batch.column(0).to_numpy()
            t = np.array(batch.column(1).to_pylist(), dtype=np.float64)
            n = np.linalg.norm(t, axis=1, keepdims=True)
            t = np.divide(t, n, out=np.zeros_like(t), where=n > 0)
            for a in range(0, len(ids), 1024):
                s = unit[a : a + 1024] @ t.T
                for i, row in enumerate(s):
                    row = np.where(tid == ids[a + i], -np.inf, row)
                    least = np.partition(row, -k)[-k] - 1e-9 if len(row) > k else -np.inf
                    new = [(-float(row[j]), int(tid[j])) for j in np.flatnonzero((row >= least) & np.isfinite(row))]
                    best[a + i] = sorted(best.get(a + i, []) + new, key=lambda x: (round(x[0], 9), x[1]))[:k]
        rows = [(int(ids[i]), b, -s) for i, found in best.items() for s, b in found]
        cols = list(zip(*rows, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["qid", "id", "similarity"])

    found = targets.select("id", F.transform("v", lambda x: x.cast("double")).alias("v")).mapInArrow(look, "qid long, id long, similarity double")
    if keep:
        found = cut(found)
        sent.unpersist()
    return found


def simhash(tokens: Column, weigh: int = 64) -> Column:
    """64-bit SimHash of an array of tokens: bit b is set if more tokens have bit b set in their hash than not.

    A token's hash is the first 16 hex digits of its sha256. All 64 sums run in one pass over the array, two halves of
    32 counters packed in an array; no token is exploded. No tokens give 0.
    """
    hashes = F.transform(tokens, lambda t: F.conv(F.substring(F.sha2(t, 256), 1, 16), 16, -10).cast("long"))
    zero = F.array_repeat(F.lit(0), weigh)
    bits = F.sequence(F.lit(0), F.lit(weigh - 1))
    sums = F.aggregate(hashes, zero, lambda acc, h: F.zip_with(acc, bits, lambda s, b: (s + 2 * F.getbit(h, b).cast("int") - 1).cast("int")))
    return F.aggregate(F.zip_with(sums, bits, lambda s, b: F.when(s > 0, F.expr("1L")).otherwise(F.expr("0L"))), F.struct(F.lit(0).alias("b"), F.expr("0L").alias("v")), lambda a, x: F.struct((a["b"] + 1).alias("b"), (a["v"].bitwiseOR(F.call_function("shiftleft", x, a["b"]))).alias("v")), lambda a: a["v"])


def hamming_pairs(signatures: DataFrame, most: int = 3, alike: int = 2) -> DataFrame:
    """(a, b, distance) of distinct signatures (column sig) at most ``most`` bits apart, a < b.

    With most + alike bands two such signatures agree in ``alike`` bands at least (pigeonhole), so that an equi-join on
    every choice of so many bands is exact: ten keys of 25 bits each for three bits. More bands that must agree give
    more and longer keys, for more signatures. A pair that agrees in several choices is told by the first of them alone,
    so that no pair need be sent again to be made distinct.
    """
    bands = most + alike
    edges = [64 * k // bands for k in range(bands + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(edges)]
    choices = list(itertools.combinations(range(bands), alike))
    long = lambda x: F.lit(x - (1 << 64) if x >= 1 << 63 else x).cast("long")
    sigs = signatures.select("sig").where("sig is not null").distinct()
    keys = [F.struct(F.lit(k).alias("k"), F.col("sig").bitwiseAND(long(sum(masks[i] for i in c))).alias("x")) for k, c in enumerate(choices)]
    p = sigs.select("sig", F.explode(F.array(*keys)).alias("p")).select("sig", "p.k", "p.x")
    a, b = p.select(F.col("sig").alias("a"), "k", "x"), p.select(F.col("sig").alias("b"), "k", "x")
    unlike = F.col("a").bitwiseXOR(F.col("b"))
    same = [unlike.bitwiseAND(long(m)) == 0 for m in masks]
    first = F.coalesce(*[F.when(reduce(lambda x, y: x & y, [same[i] for i in c]), F.lit(k)) for k, c in enumerate(choices)])
    d = F.bit_count(unlike)
    return a.join(b, ["k", "x"]).where(F.col("a") < F.col("b")).where(d <= most).where(first == F.col("k")).select("a", "b", d.alias("distance"))
