"""Problem 1: rows that report the same thing with small edits, by an LSH forest.

Each of several orders ranks a row's tokens anew (see ``signatures``), which gives the row one signature per order. The
rows of an order are sorted by signature; those with a long common prefix are neighbours and so candidates. How long the
prefix must be is settled per region: a region of few rows is taken at its first token, a populous one is descended, by
the number of rows really in it. What is still populous at the last token is joined with itself, so that nothing is
lost. Two orders with a short common prefix, or one with a long one, make a candidate; the sets of tokens decide, by
exact counts.

Equal texts are one class from the start. Classes, not rows, go through the forest; rows come back at the end. Sides
that grow with the data are joined by sorting and merging: none of them is ever sent to the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, tidy
from .signatures import REGION, SHARE, depth_of, neighbours, rarity, set_rows, signature_rows, token_rows

#: Orders of the forest. A pair with weighted similarity 0.6 is missed with a probability of 2e-6 where regions are taken
#: at one token, 4e-3 at two, 1e-2 at three and 8e-2 at four.
ORDERS = 18
#: So many points make a candidate: a common prefix of LONG or more tokens gives two, a shorter one gives one.
POINTS = 2
LONG = 3


def finding_texts(findings: DataFrame) -> DataFrame:
    """id, grp, text of the findings that can be alike: rows with NULL description or category are alike to none."""
    return findings.where(F.col("description").isNotNull() & F.col("category").isNotNull() & F.col("finding_key").isNotNull()).select(
        F.col("finding_key").alias("id"), tidy(F.col("category")).alias("grp"), F.concat_ws(" ", "description", F.col("evidence.snippet")).alias("text")
    )


def alike(shared: Column, a: Column, b: Column, num: int, den: int) -> Column:
    """shared / (a + b - shared) >= num / den in whole numbers; two empty sets are alike."""
    return shared * den >= (a + b - shared) * num


def merged(left: DataFrame, right: DataFrame, on: str | list[str]) -> DataFrame:
    """An inner join by sorting and merging, whatever the sizes seem to be; skewed keys are split by Spark."""
    return left.join(right.hint("merge"), on)


def class_pairs(rows: DataFrame, num: int = 6, den: int = 10, orders: int = ORDERS, share: float = SHARE, region: int = REGION) -> DataFrame:
    """Pairs (ha, hb), ha < hb, of classes of equal token sets in one group whose similarity is at least num / den."""
    table = rows.sparkSession.sparkContext.broadcast(rarity(rows))  # 2**19 bytes, whatever the input
    trees = signature_rows(rows.select("h", "tokens", "salt"), table, orders, share, region, num, den).select(F.explode("keys").alias("key"), "h")

    def found(cols: list[np.ndarray], a: np.ndarray, b: np.ndarray, depth: np.ndarray) -> list[np.ndarray]:
        ha, hb = cols[1][a], cols[1][b]
        points = np.where(depth >= LONG, 2, 1).astype(np.int32)
        other = ha != hb
        return [np.minimum(ha, hb)[other], np.maximum(ha, hb)[other], points[other]]

    near, left = neighbours(trees, found, [("ha", pa.int64()), ("hb", pa.int64()), ("points", pa.int32())], region)
    left = left.distinct()
    rest = merged(left.select("key", F.col("h").alias("ha")), left.select("key", F.col("h").alias("hb")), "key").where("ha < hb")
    near = near.union(rest.select("ha", "hb", F.when(depth_of(F.col("key")) >= LONG, 2).otherwise(1).alias("points")))
    near = near.groupBy("ha", "hb").agg(F.sum("points").alias("points")).where(F.col("points") >= POINTS).select("ha", "hb")
    sets = set_rows(rows)
    both = merged(merged(near, sets.select(F.col("h").alias("ha"), F.col("tokens").alias("ta")), "ha"), sets.select(F.col("h").alias("hb"), F.col("tokens").alias("tb")), "hb")
    shared = both.withColumn("shared", F.size(F.array_intersect("ta", "tb")))
    return shared.where(alike(F.col("shared"), F.size("ta"), F.size("tb"), num, den)).select("ha", "hb")


def near_duplicate_pairs(texts: DataFrame, num: int = 6, den: int = 10) -> DataFrame:
    """All pairs (id_a, id_b), id_a < id_b, of rows in one group whose token sets are alike.

    ``texts`` has id, grp, text. NULL texts count as empty; two empty texts in a group are alike. Rows repeated under
    one id give no pair of that id with itself. An empty table gives an empty result.
    """
    tokens = token_rows(texts, "id")
    pairs = class_pairs(tokens, num, den)
    rows = tokens.select("id", "h").distinct()
    repeated = rows.groupBy("h").count().where("count > 1").select(F.col("h").alias("ha"), F.col("h").alias("hb"))
    a, b = rows.select(F.col("h").alias("ha"), F.col("id").alias("ia")), rows.select(F.col("h").alias("hb"), F.col("id").alias("ib"))
    out = merged(merged(pairs.union(repeated), a, "ha"), b, "hb").where("ia <> ib and (ha <> hb or ia < ib)")
    return out.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of undirected edges (a, b); a component's name is its least node.

    Alternates large and small stars until nothing changes; each round is cut, none is collected. Every node only ever
    sends its neighbours, so a hub costs its number of edges and is split by the shuffle of its neighbours.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = merged(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = merged(large, down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = cut(small.where("u <> v").distinct())
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def near_duplicate_groups(texts: DataFrame, num: int = 6, den: int = 10) -> DataFrame:
    """One row per id: class_id (least id of the equal texts), group_id (least id linked to it, over any number of
    steps), class_size and links (number of other rows alike to it). Copies are not expanded into pairs."""
    tokens = token_rows(texts, "id")
    rows = cut(tokens.select("id", "h").distinct())
    classes = rows.groupBy("h").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    pairs = cut(class_pairs(tokens, num, den))
    sized = classes.select(F.col("h").alias("hb"), F.col("class_size").alias("size_b"))
    ends = pairs.union(pairs.select("hb", "ha"))
    linked = merged(ends, sized, "hb").groupBy(F.col("ha").alias("h")).agg(F.sum("size_b").alias("outer"))
    named = merged(merged(pairs, classes.select(F.col("h").alias("ha"), F.col("class_id").alias("a")), "ha"), classes.select(F.col("h").alias("hb"), F.col("class_id").alias("b")), "hb")
    comp = components(named.select("a", "b"))
    full = classes.join(linked.hint("merge"), "h", "left").join(comp.withColumnRenamed("node", "class_id").hint("merge"), "class_id", "left")
    full = full.select("h", "class_id", "class_size", F.coalesce("component", "class_id").alias("group_id"), (F.col("class_size") - 1 + F.coalesce("outer", F.lit(0))).alias("links"))
    return merged(rows, full, "h").select("id", "class_id", "group_id", "class_size", "links")
