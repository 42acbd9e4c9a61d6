"""Weighted samples of token sets, the base of the LSH forest (p1) and of the rotated block tables (p3).

A text's tokens are ranked anew in each of several orders by -ln(u) / weight, u being a hash of the token in (0, 1) and
the weight falling with the number of rows that have the token. Two sets then have the same first token with a
probability equal to their weighted Jaccard similarity, so that what all rows say (templates, common words) hardly ever
decides and what is particular to a report nearly always does. The ranking of an order is a row's signature there.

A key is a signature's beginning, packed so that sorting the keys of an order sorts its signatures: a head of at least
one token, and two more tokens after it. ``neighbours`` sorts all keys and finds, within each sorted run, the regions of
rows with a common prefix. A region of few rows is taken whole; a populous one is descended, token by token, by the
number of rows that really are in it.

The numbers of rows come from a table of counts over hashed tokens (``rarity``). It is counted over every row and has a
fixed number of entries (2 * 2**BUCKET_BITS bytes when sent), whatever the number of rows or tokens. Only tokens that at
least one row in ``SHARE`` has are told as common by it. As the entries of a table of 2**18 hold 1/7700 of all rows by
chance at most (34 tokens a row, no token repeated), that judgement is the same at every size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, signed

BUCKET_BITS = 18
#: Entries of ``rarity`` are so many times the base-2 logarithm of a count; in 16 bits they hold counts up to 2**1023.
STEPS = 64
#: A head goes on behind tokens that more than one row in so many has, and more rows than a region may have.
SHARE = 1024
#: Tokens of a signature that a key can tell apart, the head's and those after it.
DEPTH = 4
#: A region of at most so many rows is not descended further.
REGION = 500
#: Sets of at most so many tokens meet by their subsets, exactly.
FEW = 8
#: Bits of each token after the head, and the place of the head's number of tokens above them.
AFTER = 10
DEEP = 2 * AFTER
HEAD = DEEP + 2


def token_rows(df: DataFrame, *keep: str) -> DataFrame:
    """Rows (grp, text, *keep) to (*keep, h, tokens): the set of 64-bit token hashes and a hash of group and set.

    NULL texts count as empty; the empty set of a group is a class like any other.
    """
    found = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z0-9_]+)"))
    hashed = df.select("grp", *keep, F.array_distinct(F.transform(found, lambda t: F.xxhash64(t))).alias("tokens"))
    return hashed.select(*keep, F.xxhash64("grp", F.sort_array("tokens")).alias("h"), "tokens", F.xxhash64("grp").alias("salt"))


def rarity(rows: DataFrame, bits: int = BUCKET_BITS) -> np.ndarray:
    """For each bucket of hashed tokens the base-2 logarithm, in 1 / STEPS, of the number of rows that have it.

    ``rows`` has tokens. The last entry is that of the number of rows. The result has 2 * (2**bits + 1) bytes, and as
    many rows at most come to the driver.
    """
    each = rows.select(F.explode(F.concat(F.transform("tokens", lambda t: F.shiftrightunsigned(t, 64 - bits)), F.array(F.lit(1 << bits).cast("long")))).alias("b"))
    got = each.groupBy("b").count().select(F.col("b").cast("int").alias("b"), F.round(F.log2(F.col("count") + 1) * STEPS).cast("int").alias("v")).toArrow()
    out = np.zeros((1 << bits) + 1, dtype=np.uint16)
    out[got.column("b").to_numpy()] = got.column("v").to_numpy()
    return out


class Sampler:
    """The keys of each set in each of ``orders`` rankings."""

    def __init__(self, table: np.ndarray, orders: int, share: float = SHARE, region: float | None = None, depth: int = DEPTH):
        bits = int(len(table) - 1).bit_length() - 1
        self.shift, self.orders, self.depth = np.uint64(64 - bits), orders, depth
        logs = table.astype(np.float64) / STEPS
        self.common = logs[:-1] > np.maximum(logs[-1] - np.log2(share), np.log2(1 + (REGION if region is None else region)))
        self.weight = np.square(1 + np.maximum(0, logs[-1] - logs[:-1]))

    def keys(self, flat: np.ndarray, sizes: np.ndarray, salt: np.ndarray, room: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """((sets, orders) keys, prints): see ``HEAD`` for the layout; prints have 4 bits of the first token of each of
        the first 16 orders. A head ends at the first token that is not common, and at ``depth`` tokens at the latest.

        Sets are taken in blocks of about one size, of at most ``room`` tokens, or one set if it has more.
        """
        keys, prints = np.zeros((len(sizes), self.orders), dtype=np.uint64), np.zeros(len(sizes), dtype=np.uint64)
        starts = np.cumsum(sizes) - sizes
        by_size = np.argsort(sizes, kind="stable")
        by_size = by_size[sizes[by_size] > 0]
        while len(by_size):
            n = len(by_size)
            while n > 1 and n * sizes[by_size[n - 1]] > room:
                n = max(1, min(n - 1, int(room // sizes[by_size[n - 1]])))
            some, by_size = by_size[:n], by_size[n:]
            at = np.arange(sizes[some[-1]])
            has = at[None, :] < sizes[some][:, None]
            tokens = flat[np.where(has, starts[some][:, None] + at[None, :], 0)]
            self._block(tokens, has, salt[some], keys, prints, some)
        return keys, prints

    def _block(self, tokens: np.ndarray, has: np.ndarray, salt: np.ndarray, keys: np.ndarray, prints: np.ndarray, some: np.ndarray) -> None:
        each = np.arange(len(tokens))
        bucket = (tokens >> self.shift).astype(np.int64)
        weight, common = self.weight[bucket], self.common[bucket]
        for k in range(self.orders):
            u = ((mix(tokens, k + 101) >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
            rank = np.where(has, -np.log(u) / weight, np.inf)
            head = mix(salt, k + 1)
            going = np.ones(len(tokens), dtype=bool)
            length, after, done = np.zeros(len(tokens), dtype=np.int64), np.zeros(len(tokens), dtype=np.uint64), np.zeros(len(tokens), dtype=np.int64)
            for level in range(self.depth):
                pos = rank.argmin(axis=1)
                live = np.isfinite(rank[each, pos])
                h = mix(tokens[each, pos], 41)
                if level == 0 and k < 16:
                    prints[some] |= (mix(h, k + 19) & np.uint64(15)) << np.uint64(4 * k)
                adds = going & live
                with np.errstate(over="ignore"):
                    head = np.where(adds, mix(head * np.uint64(31) + h, level + 1), head)
                length += adds
                tells = ~going & live & (done < 2)
                after |= np.where(tells, (h & np.uint64((1 << AFTER) - 1)) << (AFTER * (1 - np.minimum(done, 1))).astype(np.uint64), np.uint64(0))
                done += tells
                going = adds & common[each, pos]
                rank[each, pos] = np.inf
                if not (going | live & (done < 2)).any():
                    break
            keys[some, k] = head >> np.uint64(HEAD) << np.uint64(HEAD) | (length - 1).astype(np.uint64) << np.uint64(DEEP) | after


#: The place behind the head in keys of subsets; those of a head of DEPTH tokens have 0 there.
SUBSET = 1


def subset_keys(tokens: np.ndarray, salt: np.uint64, num: int, den: int) -> np.ndarray:
    """A key for each subset that has at least num / den of a set's tokens.

    Sets with a similarity of num / den have that share of either in common, so that they always share a key.
    """
    n = len(tokens)
    masks = np.arange(1, 1 << n)
    has = (masks[:, None] >> np.arange(n)) & 1 == 1
    has = has[has.sum(axis=1) * den >= n * num]
    with np.errstate(over="ignore"):
        both = mix(np.bitwise_xor.reduce(np.where(has, mix(tokens, 23), np.uint64(0)), axis=1) + salt, 29)
    return both >> np.uint64(HEAD) << np.uint64(HEAD) | np.uint64(DEPTH - 1) << np.uint64(DEEP) | np.uint64(SUBSET)


def signature_rows(rows: DataFrame, table, orders: int, share: float = SHARE, region: int = REGION, num: int = 6, den: int = 10, use: int | None = None) -> DataFrame:
    """Rows of ``token_rows`` to (kept columns, h, keys, print); ``table`` is a broadcast variable.

    keys has one key for each of the first ``use`` orders (all, if not given). Sets of few
    tokens, among them all that a key could run out of and those that may be alike to one (num / den), have the keys of
    their subsets after these. Of
    rows that agree in everything but the tokens' places only the first of each batch is kept: copies of one text are
    not sent on one by one. Empty sets have no keys.
    """
    kept = [f for f in rows.schema.fields if f.name not in ("tokens", "salt")]
    names = [f.name for f in kept]
    few = max(FEW, (DEPTH - 1) * den // num)
    use = orders if use is None else use

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(table.value, orders, share, region)
        for batch in batches:
            if batch.num_rows > 1:
                first = pa.Table.from_batches([batch.select(names)]).append_column("i", pa.array(np.arange(batch.num_rows))).group_by(names, use_threads=False).aggregate([("i", "min")])
                batch = batch.take(pa.array(np.sort(first.column("i_min").to_numpy())))
            lists = batch.column("tokens")
            sizes = np.asarray(lists.value_lengths()).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            salt = batch.column("salt").to_numpy().view(np.uint64)
            keys, prints = sampler.keys(flat, sizes, salt)
            own = np.where(sizes > 0, use, 0)
            values = keys[sizes > 0, :use].ravel()
            short = np.flatnonzero((sizes > 0) & (sizes <= few))
            if len(short):
                starts = np.cumsum(sizes) - sizes
                ends = np.cumsum(own)
                more = [subset_keys(flat[starts[i] : starts[i] + sizes[i]], salt[i], num, den) for i in short]
                values = np.insert(values, np.repeat(ends[short], [len(m) for m in more]), np.concatenate(more))
                own[short] += [len(m) for m in more]
            ends = np.concatenate(([0], np.cumsum(own))).astype(np.int32)
            cols = [pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(signed(values))), pa.array(signed(prints))]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *cols], names=[*names, "keys", "print"])

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept] + ["keys array<long>", "print long"])
    return rows.mapInArrow(sign, schema)


class Regions:
    """Cut a stream of sorted keys into regions of rows with a common prefix.

    ``feed`` takes arrays sorted by key and then by h and yields (columns, region number, tokens in common, whether the
    region is whole): a region is whole if it has at most ``most`` rows, and then comes in one piece. Of others, which
    all tokens of the keys leave together, rows come in pieces. Rows that repeat both key and h are dropped. No more
    than ``most`` rows and one batch are held, whatever the number of rows with a common prefix.
    """

    SHIFTS = (DEEP, AFTER, 0)

    def __init__(self, most: int):
        self.most = most
        self.held: list[np.ndarray] | None = None
        self.over: list[int | None] = [None, None, None]  # prefixes known to be populous though part of them has gone

    def feed(self, cols: list[np.ndarray], last: bool = False):
        if self.held is not None:
            cols = [np.concatenate((a, b)) for a, b in zip(self.held, cols, strict=True)]
        self.held = None
        keys, h = cols[0], cols[1]
        if not len(keys):
            return
        fresh = np.concatenate(([True], (keys[1:] != keys[:-1]) | (h[1:] != h[:-1])))
        if not fresh.all():
            cols = [c[fresh] for c in cols]
            keys = cols[0]
        n = len(keys)
        to = n
        if not last:
            to = 0
            for level, s in enumerate(self.SHIFTS):  # hold back the last run, unless it is known to be populous
                prefix = keys >> np.uint64(s)
                start = n - int((prefix[::-1] == prefix[-1]).argmin()) if prefix[0] != prefix[-1] else 0
                to = start
                if n - start <= self.most and self.over[level] != int(prefix[-1]):
                    break
                if level == 2:
                    to = n
            if to < n:
                self.held = [c[to:] for c in cols]
        if not to:
            return
        sizes, runs = [], []
        tail = keys[-1]
        for level, s in enumerate(self.SHIFTS):
            prefix = keys >> np.uint64(s)
            starts = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1])))
            count = np.diff(np.append(starts, n))
            if self.over[level] is not None:
                count = np.where(prefix[starts] == np.uint64(self.over[level]), self.most + 1, count)
            sizes.append(np.repeat(count, np.diff(np.append(starts, n))))
            runs.append(np.repeat(starts, np.diff(np.append(starts, n))))
            populous = sizes[level][-1] > self.most
            self.over[level] = int(tail >> np.uint64(s)) if populous else None
        fits = [x <= self.most for x in sizes]
        region = np.where(fits[0], runs[0], np.where(fits[1], runs[1], runs[2]))
        used = np.where(fits[0], 0, np.where(fits[1], 1, 2))
        whole = fits[0] | fits[1] | fits[2]
        depth = np.minimum(((keys >> np.uint64(DEEP)) & np.uint64(3)).astype(np.int64) + 1 + used, DEPTH)
        yield [c[:to] for c in cols], region[:to], depth[:to], whole[:to]


def _arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
    cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
    return [cols[0].view(np.uint64), *cols[1:]]


def neighbours(trees: DataFrame, found: Callable[[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]], columns: list[tuple[str, pa.DataType]], region: int = REGION, order: tuple[str, ...] = ("key", "h")) -> tuple[DataFrame, DataFrame]:
    """(pairs, left): pairs of rows in one region of at most ``region`` rows, and the rows of larger ones.

    ``trees`` has key, h and more columns without NULLs; ``found`` gets these as arrays, the places a and b of pairs of rows and the number
    of tokens that the two have in common, and gives the arrays of ``columns``. ``left`` has trees' columns: what all
    tokens of a key leave together. It is to be joined with itself on key, where Spark splits what is skewed.

    Rows are shuffled by the head of their key, of which no token but common ones is repeated in more than one row of
    SHARE, and sorted by the whole (``order``). Both results read one shuffle.
    """
    names = trees.columns
    laid = trees.repartition(F.shiftrightunsigned("key", DEEP)).sortWithinPartitions(*order)

    def stream(batches: Iterator[pa.RecordBatch]):
        regions, empty = Regions(region), None
        for batch in batches:
            cols = _arrays(batch)
            empty = [c[:0] for c in cols]
            yield from regions.feed(cols)
        if empty is not None:
            yield from regions.feed(empty, last=True)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, number, depth, whole in stream(batches):
            at, gap, n = np.flatnonzero(whole), 1, len(number)
            got, size = [], 0
            while len(at):
                at = at[at + gap < n]
                at = at[number[at + gap] == number[at]]
                if len(at):
                    out = found(cols, at, at + gap, depth[at])
                    if len(out[0]):
                        got.append(out)
                        size += len(out[0])
                gap += 1
                if size > 100_000 or got and not len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), type=t) for c, (_, t) in zip(zip(*got, strict=True), columns, strict=True)], names=[n for n, _ in columns])
                    got, size = [], 0

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, _, _, whole in stream(batches):
            if not whole.all():
                yield pa.RecordBatch.from_arrays([pa.array(c[~whole] if i else signed(c[~whole])) for i, c in enumerate(cols)], names=names)

    kinds = {pa.int64(): "long", pa.int32(): "int"}
    found_schema = ", ".join(f"{n} {kinds[t]}" for n, t in columns)
    left_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in trees.schema.fields)
    return laid.mapInArrow(pairs, found_schema), laid.mapInArrow(rest, left_schema)


def depth_of(key: Column) -> Column:
    """Tokens that rows with this whole key have in common."""
    return F.least(F.lit(DEPTH), F.shiftrightunsigned(key, DEEP).bitwiseAND(F.lit(3).cast("long")) + 3).cast("int")


def set_rows(rows: DataFrame) -> DataFrame:
    """(h, tokens), one row for each class, the tokens as 32-bit hashes.

    32 bits are enough to count common tokens: in a pair of sets of 50 tokens any two differing tokens collide with a
    probability below one in a million.
    """
    small = rows.select("h", F.transform("tokens", lambda t: F.shiftright(t, 32).cast("int")).alias("tokens"))
    return small.groupBy("h").agg(F.first("tokens").alias("tokens"))
