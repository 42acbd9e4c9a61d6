"""Queries of the near-duplicate cascade: exact, SimHash and vector tiers, and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import scalars as S
from quern.operators import cascade, vectors
from quern.sources.tables import table


#: Centroids that may be sent to every task, of some hundred numbers each.
MOST_LABELS = 4096


def dedup_exact(spark: SparkSession, d: str) -> DataFrame:
    """Repeated texts of documents: their hash, number, and first id."""
    t = table(spark, d, "documents").where("text is not null and doc_id is not null")
    return t.groupBy(F.sha2("text", 256).alias("hash")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    """finding_key and the tokens of rule and path, as the second tier has them."""
    e = F.coalesce("evidence.file", F.lit(""))
    parts = F.split(F.regexp_replace(e, r"\\", "/"), "/")
    last = F.regexp_replace(F.element_at(parts, -1), r"\.py$", "")
    path = F.concat(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(last))
    rule = F.split(F.lower(F.translate(F.coalesce("category", F.lit("")), "_", "-")), "-")
    return table(spark, d, "findings").where("finding_key is not null").select("finding_key", F.filter(F.concat(rule, path), lambda x: F.trim(x) != "").alias("tokens"))


def simhash_signature(spark: SparkSession, d: str) -> DataFrame:
    t = _tokens(spark, d)
    one = t.select(F.concat_ws("\u0001", "tokens").alias("k"), "tokens").groupBy("k").agg(F.first("tokens").alias("tokens")).select("k", vectors.simhash(F.col("tokens")).alias("sig"))
    return t.select("finding_key", F.concat_ws("\u0001", "tokens").alias("k")).join(one, "k").select("finding_key", "sig")


def simhash_pairs(spark: SparkSession, d: str) -> DataFrame:
    return vectors.hamming_pairs(simhash_signature(spark, d), 3)


def embedding_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Each vector's nearest label centroid by cosine, ties by lower label."""
    e = table(spark, d, "embeddings").where("embedding is not null")
    c = vectors.centroid_vectors(e, "label", "embedding")
    q = e.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    if e.select("label").distinct().limit(MOST_LABELS + 1).count() > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} centroids are not sent to every task")
    j = q.crossJoin(F.broadcast(c))  # as many rows as labels, checked
    s = j.select("vec_id", "label", F.round(S.cosine(F.col("v"), F.col("centroid")), 6).alias("similarity"))
    best = s.groupBy("vec_id").agg(F.max(F.struct("similarity", (-F.col("label")).alias("n"))).alias("b"))
    return best.select("vec_id", (-F.col("b.n")).alias("label"), F.col("b.similarity").alias("similarity"))


def embedding_topk(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest vectors of every vector whose id is divisible by 20."""
    e = table(spark, d, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return vectors.nearest(e.where("id % 20 = 0"), e, 3).select("qid", "id", F.round("similarity", 6).alias("similarity"), "place")


def cluster_centroid(spark: SparkSession, d: str) -> DataFrame:
    return vectors.centroids(table(spark, d, "embeddings"), "label", "embedding").select("label", "pos", F.round("mean", 6).alias("mean"))


def cluster_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of equal finding ids: members, rows, first and last sight, a short name."""
    f = table(spark, d, "findings").where("finding_id is not null").withColumn("fid", S.tidy(F.col("finding_id")))
    g = f.groupBy("fid").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("finding_key").alias("members"), F.unix_micros(F.min("found_at")).alias("first_seen"), F.unix_micros(F.max("found_at")).alias("last_seen"))
    return g.select(F.concat(F.lit("cl_"), S.short_hash(F.col("fid"), 8)).alias("cluster_id"), "rows", "members", "first_seen", "last_seen")


def dedup_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Leader clusters of the SimHash tier: the earliest signature takes in all within three bits, set by set."""
    f = table(spark, d, "findings").where("finding_key is not null").select("finding_key", "batch_no")
    sig = simhash_signature(spark, d).join(f, "finding_key").groupBy("sig").agg(F.min(F.struct(F.coalesce("batch_no", F.lit(1 << 30)).alias("batch"), "finding_key")).alias("at"))
    return cascade.leaders(sig, vectors.hamming_pairs(sig, 3))


QUERIES = {f.__name__: f for f in (dedup_exact, simhash_signature, simhash_pairs, embedding_nearest, embedding_topk, cluster_centroid, cluster_rollup, dedup_cascade)}

_TOK = (
    r"t AS (SELECT finding_key, list_filter(list_concat(string_split(lower(translate(coalesce(category, ''), '_', '-')), '-'), p[1:len(p) - 1], [regexp_replace(p[len(p)], '\.py$', '')]), lambda x: trim(x) <> '') AS toks "
    r"FROM (SELECT *, string_split(replace(coalesce(evidence.file, ''), '\', '/'), '/') AS p FROM findings WHERE finding_key IS NOT NULL))"
)
_SIM = (
    f"WITH {_TOK}, u AS (SELECT finding_key, ('0x' || substr(sha256(x), 1, 16))::ubigint AS h FROM (SELECT finding_key, unnest(toks) AS x FROM t)), b AS (SELECT finding_key, i, sum(CASE WHEN (h >> i) & 1 = 1 THEN 1 ELSE -1 END) AS s FROM u, range(0, 64) r(i) GROUP BY 1, 2), "
    "n AS (SELECT finding_key, sum(CASE WHEN s > 0 THEN (CASE WHEN i = 63 THEN -9223372036854775808::hugeint ELSE (1::hugeint << i) END) ELSE 0::hugeint END)::bigint AS sig FROM b GROUP BY 1), sg AS (SELECT t.finding_key, coalesce(n.sig, 0) AS sig FROM t LEFT JOIN n USING (finding_key))"
)
_COS = "list_cosine_similarity(a.v, b.v)"
_CENT = "c AS (SELECT label, i, avg(embedding[i]::double) AS m FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2), cv AS (SELECT label, list(m ORDER BY i) AS v FROM c GROUP BY 1)"

SQL = {
    "dedup_exact": "SELECT sha256(text) AS hash, count(*) AS copies, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "simhash_signature": f"{_SIM} SELECT finding_key, sig FROM sg",
    "simhash_pairs": f"{_SIM}, d AS (SELECT DISTINCT sig FROM sg) SELECT a.sig AS a, b.sig AS b, bit_count(xor(a.sig, b.sig)) AS distance FROM d a JOIN d b ON a.sig < b.sig AND bit_count(xor(a.sig, b.sig)) <= 3",
    "embedding_nearest": f"WITH {_CENT}, q AS (SELECT vec_id, embedding::double[] AS v FROM embeddings), s AS (SELECT vec_id, b.label, round({_COS}, 6) AS similarity FROM q a, cv b), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, label) AS rn FROM s) SELECT vec_id, label, similarity FROM r WHERE rn = 1",
    "embedding_topk": f"WITH q AS (SELECT vec_id, embedding::double[] AS v FROM embeddings), s AS (SELECT a.vec_id AS qid, b.vec_id AS id, {_COS} AS x FROM q a JOIN q b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(x, 9) DESC, id) AS place FROM s) "
    "SELECT qid, id, round(x, 6) AS similarity, place FROM r WHERE place <= 3",
    "cluster_centroid": "SELECT label, i - 1 AS pos, round(avg(embedding[i]::double), 6) AS mean FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2",
    "cluster_rollup": r"SELECT 'cl_' || substr(sha256(lower(regexp_replace(finding_id, '^\s+|\s+$', '', 'g'))), 1, 8) AS cluster_id, count(*) AS rows, count(DISTINCT finding_key) AS members, epoch_us(min(found_at)) AS first_seen, epoch_us(max(found_at)) AS last_seen FROM findings WHERE finding_id IS NOT NULL GROUP BY lower(regexp_replace(finding_id, '^\s+|\s+$', '', 'g'))",
}
