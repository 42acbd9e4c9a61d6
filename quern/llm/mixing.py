"""Problem 8: interleave sources in the proportions of target weights, by Pfair scheduling.

Every source is a task of weight w (its share of the mix) whose j-th block is released at slot floor(j / w) and must be
placed before slot ceil((j + 1) / w). Each slot takes, of the blocks released so far, the one with the earliest deadline,
which keeps each source within less than one block of its share at every slot. Weights are whole numbers of slots in a
period of at most ``PERIOD``, after which all sources have exactly their share and the order repeats: the scheduler runs
over one period, and every block of any later one finds its slot by its number alone.

A source that has too little, even used max_repeats times, gives what it has; the report says which these are. Sources
without a target take no part in the mix but count towards the total that the targets are shares of.
"""

from __future__ import annotations

import base64
import heapq
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, tidy

#: Runs of anything but white space, as str.split has it.
WORDS = r"(?U)[^\s\x1c-\x1f]+"
#: Parts in which a source is numbered, so that the largest is not numbered by one task: so many, or as many as parts of
#: PART_ROWS rows on average take.
PARTS, PART_ROWS = 256, 1_000_000
#: Slots of a period at most; one such table is made and sent. More targets than MOST_TARGETS are refused.
PERIOD, MOST_TARGETS = 1 << 16, 4096
DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the tokenizer's files are meant to cut text before merging (part of its definition).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORDS)).cast("long")


def token_counts(documents: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, source) with size in tokens of a public tokenizer; the file at ``tokenizer`` must be on all executors."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizer, "rb"))}
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            sizes = [len(enc.encode_ordinary(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(sizes, type=pa.int64())], names=["doc_id", "source", "size"])

    return documents.where("text is not null and source is not null").select("doc_id", "source", "text").mapInArrow(count, "doc_id long, source string, size long")


def sized_by_words(documents: DataFrame) -> DataFrame:
    return documents.where("text is not null and source is not null").select("doc_id", "source", word_count(F.col("text")).alias("size"))


def plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per source of ``targets``: source, size, total, wanted, given, short, actual_share.

    ``sized`` has source, size (rows with NULL in either don't count); sources are matched but for letter case and
    outer blanks. wanted is target_share * total; given is at most size * max_repeats; short says that even that is
    below wanted. A source without rows has size 0. actual_share is of what is given in all (0 if nothing is).
    """
    by = sized.where("source is not null and size is not null").groupBy(tidy(F.col("source")).alias("key")).agg(F.sum("size").alias("size"))
    total = by.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    t = targets.where("source is not null").select("source", tidy(F.col("source")).alias("key"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))
    rows = t.join(by, "key", "left").crossJoin(F.broadcast(total)).withColumn("size", F.coalesce("size", F.lit(0)))  # total is one row
    rows = rows.withColumn("wanted", F.col("target_share") * F.col("total")).withColumn("most", F.col("size") * F.col("max_repeats"))
    rows = rows.withColumn("short", F.col("most") < F.col("wanted")).withColumn("given", F.least(F.col("most").cast("double"), "wanted"))
    everything = rows.agg(F.sum("given").alias("all_given"))
    return rows.crossJoin(F.broadcast(everything)).select(
        "source", "key", "target_share", "max_repeats", "size", "total", "wanted", "short", "given", F.when(F.col("all_given") > 0, F.col("given") / F.col("all_given")).otherwise(0.0).alias("weight")
    )


def quantised(blocks: dict[str, int], most: int = PERIOD) -> dict[str, int]:
    """Slots of each source in one period, in proportion to its blocks: exactly, if these are at most ``most`` in all.

    Otherwise by largest remainders, at least one each, so that a share of the mix is off by at most 1 / most.
    """
    blocks = {k: n for k, n in blocks.items() if n > 0}
    every = sum(blocks.values())
    if every <= most:
        return blocks
    out = {k: max(1, n * most // every) for k, n in blocks.items()}
    over = most - sum(out.values())
    order = sorted(blocks, key=lambda k: (-((blocks[k] * most) % every), k)) if over > 0 else sorted(blocks, key=lambda k: (-out[k], k))
    for i in range(abs(over)):
        out[order[i % len(order)]] += 1 if over > 0 else -1
    return out


def period(slots: dict[str, int]) -> list[str]:
    """The source of each slot of a period: of the blocks released so far the one with the earliest deadline.

    The weight of a source is its number n of slots over all, q; its block j is released at slot floor(j q / n) and due
    before slot ceil((j + 1) q / n). All is counted in whole numbers. At full use of one machine this order meets every
    deadline, so that at any slot every source has its share but for less than one block.
    """
    q = sum(slots.values())
    waiting = [(0, name, 0) for name in sorted(slots)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for t in range(q):
        while waiting and waiting[0][0] <= t:
            _, name, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * q // slots[name]), name, j))
        _, name, j = heapq.heappop(ready)
        out.append(name)
        if j + 1 < slots[name]:
            heapq.heappush(waiting, ((j + 1) * q // slots[name], name, j + 1))
    return out


def schedule(sized: DataFrame, targets: DataFrame, block: int = 4096, most: int = PERIOD) -> DataFrame:
    """The mix: a row (doc_id, source, units, pass_no, start, block_no, slot) for each use of a document.

    Documents of a source are numbered by their running size in an order that a hash of doc_id gives; start is where a
    use begins in what the source gives, all passes counted, and block_no is start over ``block`` units. Sorting by
    (slot, start) gives the order of the mix. The last use of a source ends with the document that reaches what the plan
    gives. ``sized`` is read once and kept as a checkpoint of a few numbers a document. Rows repeated under one doc_id,
    or with a NULL one, are each a document; those with a NULL source or no size take no part. A source without rows, or
    an empty table, gives no use.
    """
    spark = sized.sparkSession
    d = cut(sized.where("source is not null").select("doc_id", tidy(F.col("source")).alias("source"), F.col("size").cast("long").alias("size")))
    rows = plan(d, targets).limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    n_blocks = {r.key: math.ceil(r.given / block) for r in rows}
    slots = quantised(n_blocks, most)
    q = sum(slots.values())
    at: dict[str, list[int]] = {k: [] for k in slots}
    for t, k in enumerate(period(slots)):
        at[k].append(t)
    few = spark.createDataFrame([(r.key, r.source, int(r.size), float(r.given), slots[r.key]) for r in rows if r.key in slots], "key string, source string, size long, given double, slots int")
    table = spark.createDataFrame(pa.table({"key": pa.array([k for k in at for _ in at[k]], type=pa.string()), "nth": pa.array([i for k in at for i in range(len(at[k]))], type=pa.int32()), "place": pa.array([t for k in at for t in at[k]], type=pa.int32())}))

    d = d.where("size > 0").select("doc_id", F.col("source").alias("key"), F.col("size").alias("units")).join(F.broadcast(few.select("key")), "key")  # at most MOST_TARGETS rows
    parts = max(PARTS, d.count() // PART_ROWS)
    d = d.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(parts)))
    offsets = d.groupBy("key", "part").agg(F.sum("units").alias("u"))  # targets x parts rows
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("key", "part", F.coalesce(F.sum("u").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("key", "part").orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id", "units").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("inner", F.coalesce(F.sum("units").over(within), F.lit(0))).join(offsets.hint("merge"), ["key", "part"]).withColumn("first", F.col("offset") + F.col("inner"))
    used = d.join(F.broadcast(few), "key").withColumn("passes", F.ceil(F.greatest(F.lit(0.0), (F.col("given") - F.col("first")) / F.col("size"))).cast("int")).where("passes > 0")
    used = used.withColumn("pass_no", F.explode(F.sequence(F.lit(1), F.col("passes")))).withColumn("start", F.col("first") + (F.col("pass_no") - 1) * F.col("size"))
    used = used.withColumn("block_no", F.floor(F.col("start") / block)).withColumn("nth", F.pmod("block_no", "slots").cast("int"))
    placed = used.join(F.broadcast(table), ["key", "nth"])  # at most PERIOD rows
    return placed.select("doc_id", "source", "units", "pass_no", "start", "block_no", (F.floor(F.col("block_no") / F.col("slots")) * q + F.col("place")).alias("slot"))


def mix(sized: DataFrame, targets: DataFrame, block: int = 4096) -> DataFrame:
    """``schedule`` in the order of the mix."""
    return schedule(sized, targets, block).orderBy("slot", "start", "doc_id")


def shares(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """What the schedule reached: per source of the targets its units, uses and actual share beside the target.

    short says that the source's last use ends before what the target wants of it.
    """
    sized = cut(sized)
    got = schedule(sized, targets).groupBy("source").agg(F.sum("units").alias("units"), F.count(F.lit(1)).alias("uses"), F.max("pass_no").alias("passes"), F.max(F.col("start") + F.col("units")).alias("reach"))
    got = cut(got)  # a row per target
    every = got.agg(F.sum("units").alias("all_units"))
    return plan(sized, targets).drop("short").join(F.broadcast(got), "source", "left").crossJoin(F.broadcast(every)).select(
        "source", "target_share", F.coalesce("units", F.lit(0)).alias("units"), F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("passes", F.lit(0)).alias("passes"),
        F.coalesce(F.col("units") / F.col("all_units"), F.lit(0.0)).alias("actual_share"), (F.coalesce("reach", F.lit(0)) < F.col("wanted")).alias("short"),
    )
