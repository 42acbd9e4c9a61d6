"""Problem 3: a new batch against everything accepted before, at a cost that follows the batch.

A text's fingerprint has 64 bits, in which alike texts differ little (see ``prefixes``). It is stored once for each block
of the text's beginning, under the rotation that brings this block to the front: in a table keyed by the whole hash of
the block. A new text looks up the blocks of its own beginning; what matches in a block exactly is verified, first by
sizes and the number of differing bits, then by the sets of tokens themselves. The number of blocks and that of bits
follow from the sizes of the sets, so that no alike pair is lost. Afterwards the batch's own fingerprints are appended.
``replay`` does so for all batches of a table in one pass, ``HistoryStore`` batch by batch on stored tables.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import prefixes
from .common import cut, tidy
from .near_duplicates import alike, merged
from .signatures import BUCKET_BITS, REGION, STEPS, rarity, token_rows

#: Rows in these states make later rows with an alike description superfluous.
SETTLED = ("fixed", "issue-opened", "failed", "permanently_failed")
#: A batch that the past never asks, a settling that never comes.
NEVER, NO_BATCH = 2**31 - 1, -(2**31)


def arrivals(findings: DataFrame) -> DataFrame:
    """finding_key, batch, fid, text, settled; rows with NULL finding_key or batch_no can be neither new nor old."""
    return findings.where(F.col("finding_key").isNotNull() & F.col("batch_no").isNotNull()).select(
        "finding_key", F.col("batch_no").cast("int").alias("batch"), tidy(F.col("finding_id")).alias("fid"), F.col("description").alias("text"),
        F.coalesce(F.col("status").isin(*SETTLED), F.lit(False)).alias("settled"), F.lit("").alias("grp"),
    )


def classes(rows: DataFrame) -> DataFrame:
    """One row per class of equal descriptions: h, tokens (32 bits), low and high batch, first settled batch (or NULL)."""
    told = token_rows(rows.where("text is not null"), "batch", "settled")
    small = told.select("h", "batch", "settled", F.transform("tokens", lambda t: F.shiftright(t, 32).cast("int")).alias("tokens"))
    return small.groupBy("h").agg(
        F.first("tokens").alias("tokens"), F.min("batch").alias("low"), F.max("batch").alias("high"), F.min(F.when(F.col("settled"), F.col("batch"))).alias("settled_in")
    )


def verify(candidates: DataFrame, asked: DataFrame, stored: DataFrame, num: int, den: int) -> DataFrame:
    """(h, batch): the lowest batch that has a settled text alike to class h; asked and stored are (h, tokens)."""
    a, b = asked.select(F.col("h").alias("hq"), F.col("tokens").alias("tq")), stored.select(F.col("h").alias("hs"), F.col("tokens").alias("ts"))
    both = merged(merged(candidates, a, "hq"), b, "hs")
    return both.where(alike(F.size(F.array_intersect("tq", "ts")), F.size("tq"), F.size("ts"), num, den)).groupBy(F.col("hq").alias("h")).agg(F.min("batch").alias("batch"))


def replay(rows: DataFrame, num: int = 6, den: int = 10, region: int = REGION) -> DataFrame:
    """finding_key of the rows of ``arrivals`` that bring nothing new at their batch, every lower batch being history.

    A row does if a lower batch has its non-NULL finding_id in any status, or a settled row with an alike description.
    NULL ids and descriptions match nothing; two descriptions without tokens are alike; rows of one batch never match
    each other; an empty table gives an empty result.
    """
    known = rows.where("fid is not null")
    first = known.groupBy("fid").agg(F.min("batch").alias("first"))
    by_id = merged(known.select("finding_key", "fid", "batch"), first, "fid").where("batch > first").select("finding_key")

    told = rows.where("text is not null")
    table = rows.sparkSession.sparkContext.broadcast(rarity(token_rows(told)))
    every = cut(classes(told))
    # rows of a class after its own first settled batch are found as it is; the others look for a still earlier one
    open_ = F.col("settled_in").isNull() | (F.col("low") <= F.col("settled_in"))
    asks = F.when(open_, F.least("high", "settled_in")).otherwise(NO_BATCH).alias("asks")
    sides = every.select("h", "tokens", asks, F.coalesce("settled_in", F.lit(NEVER)).alias("settled")).where((F.col("asks") > NO_BATCH) | (F.col("settled") < NEVER))
    near = prefixes.look_up(prefixes.entry_rows(sides, table, num, den), num, den, region).distinct()
    sets = every.select("h", "tokens")
    alike_in = verify(near, sets, sets, num, den)
    own = every.where("settled_in is not null").select("h", F.col("settled_in").alias("batch"))
    earliest = alike_in.union(own).groupBy("h").agg(F.min("batch").alias("earliest"))
    by_text = merged(token_rows(told, "finding_key", "batch").select("finding_key", "batch", "h"), earliest, "h").where("batch > earliest").select("finding_key")
    return by_id.union(by_text).distinct()


class HistoryStore:
    """The accepted history under one shared folder: identifiers, rotated block tables, token sets, token counts.

    Every batch is a part of its own, written once and sorted by block, and a manifest names the parts that count. The
    manifest is written last, under the next free number: a batch whose writing broke off leaves nothing that is read,
    and a batch that is appended again changes nothing. Columns of history are never shuffled unless the batch's blocks
    are more than ``send``: the batch goes to where the history lies. Token sets are read only for classes that a block
    led to. The past's texts are not kept.

    Token counts are added up batch by batch. ``compact`` joins all parts in one and makes the keys anew from the counts
    of all batches; it's due when ``stale`` says that rows have doubled since keys were last made.
    """

    def __init__(self, spark: SparkSession, path: str, send: int = 1_000_000):
        self.spark, self.path, self.send = spark, path, send
        jvm = spark._jvm
        self._dir = jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
        self._fs = self._dir.getFileSystem(spark._jsc.hadoopConfiguration())
        self._path = jvm.org.apache.hadoop.fs.Path

    def _versions(self) -> list[int]:
        return sorted(int(x.getPath().getName()) for x in self._fs.listStatus(self._dir) if x.getPath().getName().isdigit()) if self._fs.exists(self._dir) else []

    def manifest(self) -> dict:
        """The newest manifest: parts, batches (numbers appended), rows and base (rows that keys were last made from)."""
        found = self._versions()
        if not found:
            return {"version": 0, "parts": [], "batches": [], "keyed": None}
        rows = self.spark.read.text(f"{self.path}/manifest/{found[-1]}").collect()  # one line
        return json.loads("".join(r.value for r in rows))

    def _publish(self, manifest: dict) -> None:
        """Write the next manifest aside, then rename it to its number, which fails if another writer was first."""
        aside = f"{self.path}/manifest/.{uuid.uuid4().hex}"
        self.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(aside)
        to = self._path(f"{self.path}/manifest/{manifest['version']}")
        if self._fs.exists(to) or not self._fs.rename(self._path(aside), to):
            raise RuntimeError("another writer has published this version")

    def _read(self, manifest: dict, name: str) -> DataFrame | None:
        parts = [f"{self.path}/parts/{p}/{name}" for p in manifest["parts"]]
        return self.spark.read.parquet(*parts) if parts else None

    @staticmethod
    def _logs(counts: np.ndarray) -> np.ndarray:
        return np.round(np.log2(counts.astype(np.float64) + 1) * STEPS).astype(np.uint16)

    def _counts(self, name: str) -> np.ndarray:
        return np.frombuffer(bytes(self.spark.read.parquet(f"{self.path}/counts/{name}").first()[0]), dtype=np.int64)

    def _count(self, told: DataFrame) -> np.ndarray:
        """Exact numbers of rows for each bucket, and of all rows."""
        bits = BUCKET_BITS
        each = token_rows(told).select(F.explode(F.concat(F.transform("tokens", lambda t: F.shiftrightunsigned(t, 64 - bits)), F.array(F.lit(1 << bits).cast("long")))).alias("b"))
        got = each.groupBy(F.col("b").cast("int").alias("b")).count().toArrow()
        out = np.zeros((1 << bits) + 1, dtype=np.int64)
        out[got.column("b").to_numpy()] = got.column("count").to_numpy()
        return out

    def stale(self) -> bool:
        m = self.manifest()
        return bool(m["parts"]) and int(self._counts(m["counts"])[-1]) > 2 * int(self._counts(m["keyed"])[-1])

    def check(self, rows: DataFrame, num: int = 6, den: int = 10) -> DataFrame:
        """finding_key of the rows of a new batch (``arrivals``) that the stored history makes superfluous."""
        m = self.manifest()
        if not m["parts"]:
            return rows.select("finding_key").limit(0)
        ids, stored, sets = (self._read(m, x) for x in ("ids", "blocks", "sets"))
        by_id = self._meet(ids, rows.where("fid is not null").select("fid", "finding_key"), "fid").select("finding_key")
        told = rows.where("text is not null")
        table = self.spark.sparkContext.broadcast(self._logs(self._counts(m["keyed"])))
        every = cut(classes(told).select("h", "tokens"))
        own = self._meet(sets.select("h"), every.select("h"), "h")
        asked = prefixes.banded(prefixes.entry_rows(every, table, num, den), num, den)[1]
        near = prefixes.meets(prefixes.side(asked, "q"), prefixes.side(stored, "s"), lambda q, s, on: self._meet(s, q, on), num, den)
        near = cut(near.select("hq", "hs", F.lit(0).alias("batch")).distinct())
        texts = self._meet(sets, near.select(F.col("hs").alias("h")).distinct(), "h").groupBy("h").agg(F.first("tokens").alias("tokens"))
        found = verify(near, every, texts, num, den).select("h").union(own.select("h")).distinct()
        by_text = merged(token_rows(told, "finding_key").select("finding_key", "h"), found, "h").select("finding_key")
        return by_id.union(by_text).distinct()

    def _meet(self, history: DataFrame, batch: DataFrame, on: str | list[str]) -> DataFrame:
        """Join stored rows with those of the batch: sent to the history if they're at most ``send``, else shuffled."""
        return history.join(F.broadcast(batch), on) if batch.count() <= self.send else merged(history, batch, on)

    def _write(self, part: str, rows: DataFrame, logs: np.ndarray) -> None:
        at = f"{self.path}/parts/{part}"
        rows.where("fid is not null").groupBy("fid").agg(F.min("batch").alias("batch")).write.parquet(f"{at}/ids")
        settled = rows.where("settled and text is not null")
        classes(settled).select("h", "tokens").sortWithinPartitions("h").write.parquet(f"{at}/sets")
        self._write_keys(at, logs)

    def _write_keys(self, at: str, logs: np.ndarray) -> None:
        """The rotated tables of a part: a row for each rotation of each fingerprint, under its leading block."""
        entries = prefixes.entry_rows(self.spark.read.parquet(f"{at}/sets"), self.spark.sparkContext.broadcast(logs))
        prefixes.banded(entries)[0].sortWithinPartitions("key", "band").write.parquet(f"{at}/blocks")

    def append(self, rows: DataFrame) -> None:
        """Take a checked batch into the history, found rows too; batches already there change nothing."""
        m = self.manifest()
        new = rows.where(~F.col("batch").isin(m["batches"])) if m["batches"] else rows
        numbers = [r.batch for r in new.select("batch").distinct().collect()]  # batches of this call
        if not numbers:
            return
        counts, name = self._count(new.where("text is not null")), uuid.uuid4().hex
        total = counts + self._counts(m["counts"]) if m["parts"] else counts
        self.spark.createDataFrame([(bytearray(total.tobytes()),)], "counts binary").write.parquet(f"{self.path}/counts/{name}")
        keyed = m["keyed"] or name
        self._write(name, new, self._logs(self._counts(keyed)))
        self._publish({"version": m["version"] + 1, "parts": [*m["parts"], name], "batches": sorted([*m["batches"], *numbers]), "counts": name, "keyed": keyed})

    def compact(self) -> None:
        """One part for all, with keys made from the token counts of all batches."""
        m = self.manifest()
        if not m["parts"]:
            return
        name, at = uuid.uuid4().hex, f"{self.path}/parts"
        self._read(m, "ids").groupBy("fid").agg(F.min("batch").alias("batch")).write.parquet(f"{at}/{name}/ids")
        self._read(m, "sets").groupBy("h").agg(F.first("tokens").alias("tokens")).sortWithinPartitions("h").write.parquet(f"{at}/{name}/sets")
        self._write_keys(f"{at}/{name}", self._logs(self._counts(m["counts"])))
        self._publish({"version": m["version"] + 1, "parts": [name], "batches": m["batches"], "counts": m["counts"], "keyed": m["counts"]})
