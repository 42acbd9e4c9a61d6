"""Rotated block tables of fingerprints (p3) that lose no pair of alike token sets.

All tokens have one order, rarest first, by the table of counts and then by their hash. Of two sets that are alike the
first token in common stands early in both: from there on each still has as many tokens as the two must share. So a set
has an entry for each token of its beginning, with its size ``n`` and ``cap``, the most tokens that a set may have to be
alike to it if this is the first token in common. Entries of one token meet if either size is within the other's cap.
Any order of the tokens gives the same results; counts decide on the cost only.

A fingerprint has 64 bits, each the parity of the tokens that fall to it. Two fingerprints never differ in more bits than
the sets have tokens apart, so that the bound on the bits (``apart``) drops no alike pair either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix
from .near_duplicates import merged
from .signatures import HEAD, REGION, neighbours

#: Sizes are told apart by so many bands for each doubling.
BANDS = 4


def band(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(n, 1)) * BANDS + 1e-9).astype(np.int32)


def least(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """The fewest tokens that a set alike to one of n tokens has; as many do they share."""
    return -(-n * num // den)


def most(n: np.ndarray, left: np.ndarray, num: int, den: int) -> np.ndarray:
    """The most tokens of a set that shares at most ``left`` tokens with one of n and is alike to it."""
    return left * (num + den) // num - n


def apart(n, num: int, den: int):
    """The most tokens that two alike sets of n tokens together have in but one of them."""
    return n - 2 * ((n * num + num + den - 1) // (num + den))


def prints(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The fingerprint of each set; those of empty sets are 0."""
    out, some = np.zeros(len(sizes), dtype=np.uint64), np.flatnonzero(sizes)
    if len(some):
        out[some] = np.bitwise_xor.reduceat(np.uint64(1) << (mix(flat, 7) >> np.uint64(58)), (np.cumsum(sizes) - sizes)[some])
    return out.view(np.int64)


def entry_rows(sets: DataFrame, table, num: int = 6, den: int = 10) -> DataFrame:
    """(key, n, cap, print, kept columns) of each set's beginning; ``sets`` has tokens (32 bits) and columns to keep.

    ``table`` is a broadcast variable (see ``rarity``). Keys have the token where ``signatures`` has a head.
    """
    kept = [f for f in sets.schema.fields if f.name != "tokens"]

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = table.value
        shift = np.uint64(32 - (int(len(counts) - 1).bit_length() - 1))
        for batch in batches:
            lists = batch.column("tokens")
            sizes = np.asarray(lists.value_lengths()).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint32).astype(np.uint64)
            told = prints(flat, sizes)
            row = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((counts[(flat >> shift).astype(np.int64)].astype(np.uint64) << np.uint64(32) | flat, row))
            flat, n = flat[order], sizes[row]
            left = n - (np.arange(len(flat)) - (np.cumsum(sizes) - sizes)[row])
            begins = left >= least(n, num, den)
            flat, n, left, row = flat[begins], n[begins], left[begins], row[begins]
            cols = [pa.array((flat << np.uint64(HEAD)).view(np.int64)), pa.array(n.astype(np.int32)), pa.array(np.minimum(most(n, left, num, den), 2**31 - 1).astype(np.int32))]
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(told[row]), *(batch.column(f.name).take(at) for f in kept)], names=["key", "n", "cap", "print", *(f.name for f in kept)])

    schema = ", ".join(["key long, n int, cap int, print long", *(f"{f.name} {f.dataType.simpleString()}" for f in kept)])
    return sets.mapInArrow(lay, schema)


def reached(entries: DataFrame, num: int = 6, den: int = 10) -> DataFrame:
    """Entries that any other of their token can meet. ``entries`` come sorted by key and ``late``.

    A late entry (its cap is below its size) meets only smaller sets that are not late. Of these, the highest cap of each
    size is all that has to be remembered while a token's entries pass by.
    """

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, caps = None, {}
        for batch in batches:
            key, n, cap = (batch.column(c).to_numpy() for c in ("key", "n", "cap"))
            keep = cap >= n
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else []
            for a, b in zip(starts, [*starts[1:], len(key)], strict=True):
                if key[a] != now:
                    now, caps = key[a], {}
                early = keep[a:b].copy()
                for size, c in {(int(x), int(y)) for x, y in zip(n[a:b][early], cap[a:b][early], strict=True)}:
                    caps[size] = max(c, caps.get(size, 0))
                late = a + np.flatnonzero(~early)
                if len(late) and caps:
                    cells, which = np.unique(n[late].astype(np.int64) << 32 | cap[late], return_inverse=True)
                    sizes, tops = np.array(list(caps)), np.array(list(caps.values()))
                    size, c = (cells >> 32)[:, None], (cells & 0xFFFFFFFF)[:, None]
                    meets = ((sizes >= least(size, num, den)) & (sizes <= c) & (tops >= size)).any(axis=1)
                    keep[late] = meets[which]
            if keep.any():
                yield batch.filter(pa.array(keep))

    return entries.mapInArrow(prune, entries.schema)


def banded(entries: DataFrame, num: int = 6, den: int = 10) -> tuple[DataFrame, DataFrame]:
    """The entries with ``band`` of their own size, and with each band that a set alike to them can be in."""

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cap = (batch.column(c).to_numpy().astype(np.int64) for c in ("n", "cap"))
            lo, hi = band(least(n, num, den)), band(np.minimum(cap, n * den // num))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(band(n)), pa.array(lo), pa.array(hi)], names=[*batch.schema.names, "band", "lo", "hi"])

    wide = entries.mapInArrow(laid, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in entries.schema.fields), "band int, lo int, hi int"]))
    return wide.drop("lo", "hi"), wide.withColumn("band", F.explode(F.sequence("lo", "hi"))).drop("lo", "hi")


def meets(q: DataFrame, s: DataFrame, join, num: int = 6, den: int = 10) -> DataFrame:
    """Pairs of entries of two ``banded`` sides, nq, cq, pq and ns, cs, ps, that can be alike; ``join`` joins the sides."""
    shared = (F.col("nq") + F.col("ns")) * num + (num + den - 1)
    few = F.bit_count(F.col("pq").bitwiseXOR(F.col("ps"))) <= F.col("nq") + F.col("ns") - 2 * F.floor(shared / (num + den))
    return join(q, s, ["key", "band"]).where("hq <> hs and nq <= cs and ns <= cq").where(few)


def side(entries: DataFrame, letter: str, *more) -> DataFrame:
    return entries.select("key", "band", *(F.col(c).alias(c[0] + letter) for c in ("h", "n", "cap", "print")), *more)


def look_up(entries: DataFrame, num: int = 6, den: int = 10, region: int = REGION) -> DataFrame:
    """Candidates (hq, hs, batch), among them every alike pair of a set that asks and one settled in a lower batch.

    ``entries`` has key, n, cap, print, h, asks (the batch up to which a text asks, the least number if it doesn't) and
    settled (the highest number if it isn't). Tokens of at most ``region`` entries are taken where they lie; the others'
    entries are pruned and joined by token and band of sizes.
    """

    def found(cols: list[np.ndarray], a: np.ndarray, b: np.ndarray, depth: np.ndarray) -> list[np.ndarray]:
        _, h, n, cap, told, asks, settled = cols[:7]
        near = (n[a] <= cap[b]) & (n[b] <= cap[a]) & (h[a] != h[b])
        a, b = a[near], b[near]
        near = np.bitwise_count((told[a] ^ told[b]).view(np.uint64)) <= apart(n[a].astype(np.int64) + n[b], num, den)
        a, b = a[near], b[near]
        one, two = settled[b] < asks[a], settled[a] < asks[b]
        q, s = np.concatenate((a[one], b[two])), np.concatenate((b[one], a[two]))
        return [h[q], h[s], settled[s]]

    trees = entries.select("key", "h", "n", "cap", "print", "asks", "settled").withColumn("late", F.col("cap") < F.col("n"))
    near, left = neighbours(trees, found, [("hq", pa.int64()), ("hs", pa.int64()), ("batch", pa.int32())], region, ("key", "late", "h"))
    own, asked = banded(reached(left, num, den), num, den)
    s = side(own.where(F.col("settled") < 2**31 - 1), "s", F.col("settled").alias("batch"))
    q = side(asked.where(F.col("asks") > -(2**31)), "q", "asks")
    rest = meets(q, s, merged, num, den).where("batch < asks")
    return near.union(rest.select("hq", "hs", "batch"))
