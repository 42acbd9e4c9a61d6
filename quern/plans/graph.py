"""Queries on the call graph (symbols, edges, changesets)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import scalars as S
from quern.operators import graph as G
from quern.sources.tables import table

DEPTH = 3


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    symbols = table(spark, d, "symbols").where("symbol_id is not null").dropDuplicates(["symbol_id"])
    return symbols, G.clean_edges(table(spark, d, "edges"), symbols)


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d)[1]


def unresolved_callees(spark: SparkSession, d: str) -> DataFrame:
    """Callees that no symbol has, and how many distinct callers name them."""
    known = table(spark, d, "symbols").select("symbol_id").distinct()
    e = table(spark, d, "edges").where("callee is not null")
    return e.join(known, e.callee == known.symbol_id, "left_anti").groupBy("callee").agg(F.countDistinct("caller").alias("callers"))


def symbol_cardinalities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "symbols").groupBy("repo_id").agg(F.countDistinct("symbol_id").alias("symbols"), F.countDistinct("path").alias("paths"))


def degree_centrality(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(_graph(spark, d)[1])


def centrality_tier(spark: SparkSession, d: str) -> DataFrame:
    return G.tiers(degree_centrality(spark, d), "degree")


def changed_symbols(spark: SparkSession, d: str) -> DataFrame:
    """(changeset_id, symbol_id): the symbols that the known paths of each changeset declare."""
    c = table(spark, d, "changesets").select("changeset_id", "repo_id", F.explode("paths").alias("path")).distinct()
    return c.join(table(spark, d, "symbols").select("repo_id", "path", "symbol_id").distinct(), ["repo_id", "path"]).select("changeset_id", "symbol_id").distinct()


def callers_bounded(spark: SparkSession, d: str) -> DataFrame:
    """For each changeset the callers of what it changes, in at most three steps, with the least number of steps."""
    _, e = _graph(spark, d)
    return G.callers_within(e, changed_symbols(spark, d), DEPTH, "changeset_id")


def invalidation_plan(spark: SparkSession, d: str) -> DataFrame:
    """Per changeset: sweep (fresh), empty or bounded; the number of affected symbols and of affected files."""
    _, e = _graph(spark, d)
    changed = G.cut(changed_symbols(spark, d))  # both the seeds and part of the answer
    near = G.callers_within(e, changed, DEPTH, "changeset_id").select("changeset_id", "symbol_id").union(changed).distinct()
    hosts = near.join(table(spark, d, "symbols").select("symbol_id", "path").distinct(), "symbol_id", "left")
    paths = hosts.select("changeset_id", F.coalesce("path", F.substring_index("symbol_id", "::", 1)).alias("path"))
    raw = table(spark, d, "changesets").select("changeset_id", F.explode("paths").alias("path")).where("path is not null")
    files = paths.union(raw).distinct().groupBy("changeset_id").agg(F.count(F.lit(1)).alias("files"))
    syms = near.groupBy("changeset_id").agg(F.count(F.lit(1)).alias("symbols"))
    c = table(spark, d, "changesets").select("changeset_id", F.coalesce("is_fresh_instance", F.lit(False)).alias("fresh"), F.coalesce(F.size(F.array_compact("paths")), F.lit(0)).alias("n"))
    mode = F.when(F.col("fresh"), "sweep").when(F.col("n") <= 0, "empty").otherwise("bounded")
    return c.join(syms, "changeset_id", "left").join(files, "changeset_id", "left").select(
        "changeset_id", mode.alias("mode"), F.when(mode == "bounded", F.coalesce("symbols", F.lit(0))).otherwise(0).alias("symbols"), F.when(mode == "bounded", F.coalesce("files", F.lit(0))).otherwise(0).alias("files")
    )


def reverse_refs(spark: SparkSession, d: str) -> DataFrame:
    """(symbol_id, path): the files that refer to a symbol, its own among them."""
    symbols, e = _graph(spark, d)
    host = symbols.select(F.col("symbol_id").alias("caller"), "path")
    return e.join(host, "caller").select(F.col("callee").alias("symbol_id"), "path").union(symbols.select("symbol_id", "path")).distinct()


def _dirty(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "changesets").where("created_at >= timestamp '2025-09-01' and not is_fresh_instance").select(F.explode("paths").alias("path")).where("path is not null").distinct()


def refresh_set(spark: SparkSession, d: str) -> DataFrame:
    """Files to read again after a change: those changed and those that refer to a symbol of a changed one."""
    dirty = _dirty(spark, d)
    hit = table(spark, d, "symbols").select("symbol_id", "path").distinct().join(dirty, "path", "left_semi").select("symbol_id")
    return reverse_refs(spark, d).join(hit, "symbol_id", "left_semi").select("path").union(dirty).distinct()


def sidecar_merge(spark: SparkSession, d: str) -> DataFrame:
    """reverse_refs kept for untouched files and made anew for refreshed ones: equal to a rebuild without lost files.

    What is made anew reads the symbols of refreshed files alone, and the edges that these call along.
    """
    fresh = refresh_set(spark, d)
    symbols, e = _graph(spark, d)
    own = symbols.join(fresh, "path", "left_semi")
    again = e.join(own.select(F.col("symbol_id").alias("caller"), "path"), "caller").select("path", F.col("callee").alias("symbol_id")).union(own.select("path", "symbol_id")).distinct()
    kept = reverse_refs(spark, d).select("path", "symbol_id").join(fresh, "path", "left_anti")  # stands for the stored table
    return kept.withColumn("origin", F.lit("kept")).union(again.withColumn("origin", F.lit("fresh")))


def importers_top3(spark: SparkSession, d: str) -> DataFrame:
    """Of each symbol the first three callers by name."""
    e = _graph(spark, d)[1]
    return e.withColumn("rn", F.row_number().over(Window.partitionBy("callee").orderBy("caller"))).where("rn <= 3")


def shard_documents(spark: SparkSession, d: str) -> DataFrame:
    """One sorted document of symbols per file."""
    s = table(spark, d, "symbols").where("symbol_id is not null").select("repo_id", "path", "name", "kind", "start_line").distinct()
    items = F.array_sort(F.collect_list(F.concat_ws(":", F.lpad(F.col("start_line").cast("string"), 6, "0"), "kind", "name")))
    return s.groupBy("repo_id", "path").agg(F.count(F.lit(1)).alias("n"), F.array_join(items, ",").alias("document"))


def impact_signal(spark: SparkSession, d: str) -> DataFrame:
    """log2(1 + callers within two steps) / log2(1 + symbols), for every symbol that is called."""
    symbols, e = _graph(spark, d)
    near = G.near_callers(e)
    total = symbols.agg(F.count(F.lit(1)).alias("total"))
    return near.crossJoin(F.broadcast(total)).select("symbol_id", "callers", F.round(S.impact(F.col("callers"), F.col("total")), 6).alias("impact"))


def priority_score(spark: SparkSession, d: str) -> DataFrame:
    """Findings with a score of impact (of their file's symbols), confidence and novelty."""
    hosts = table(spark, d, "symbols").select("symbol_id", "repo_id", "path").distinct()
    per_file = impact_signal(spark, d).join(hosts, "symbol_id").groupBy("repo_id", "path").agg(F.max("impact").alias("impact"))
    f = table(spark, d, "findings").where("finding_key is not null")
    fid = S.tidy(F.col("finding_id"))
    seen = f.where("finding_id is not null").groupBy(fid.alias("fid")).agg(F.min("batch_no").alias("first"))
    f = f.select("finding_key", "repo_id", F.col("evidence.file").alias("path"), fid.alias("fid"), "batch_no", "confidence_score")
    j = f.join(per_file, ["repo_id", "path"], "left").join(seen, "fid", "left")
    novel = F.when(F.col("batch_no") > F.col("first"), 0.0).otherwise(1.0)
    score = 0.35 * F.coalesce("impact", F.lit(0.0)) + 0.25 * F.lit(0.5) + 0.20 * F.coalesce("confidence_score", F.lit(0.0)) + 0.10 * novel + 0.10 * F.lit(0.5)
    return j.select("finding_key", F.coalesce("impact", F.lit(0.0)).alias("impact"), novel.alias("novelty"), F.round(score, 6).alias("priority"))


QUERIES = {
    f.__name__: f
    for f in (
        graph_edges, unresolved_callees, symbol_cardinalities, degree_centrality, centrality_tier, changed_symbols, callers_bounded, invalidation_plan, reverse_refs, refresh_set, sidecar_merge,
        importers_top3, shard_documents, impact_signal, priority_score,
    )
}

_G = (
    "s AS (SELECT symbol_id, min(path) AS path FROM symbols WHERE symbol_id IS NOT NULL GROUP BY 1), e AS (SELECT DISTINCT caller, callee FROM edges WHERE caller <> callee AND caller IN (SELECT symbol_id FROM s) AND callee IN (SELECT symbol_id FROM s))"
)
_DEG = f"WITH {_G}, deg AS (SELECT symbol_id, count(*) AS degree FROM (SELECT caller AS symbol_id FROM e UNION ALL SELECT callee FROM e) GROUP BY 1)"
_CH = "ch AS (SELECT DISTINCT c.changeset_id, y.symbol_id FROM (SELECT changeset_id, repo_id, unnest(paths) AS path FROM changesets) c JOIN symbols y ON y.repo_id = c.repo_id AND y.path = c.path)"
_NEAR = (
    f"WITH {_G}, {_CH}, l1 AS (SELECT DISTINCT changeset_id, caller AS symbol_id FROM ch JOIN e ON e.callee = ch.symbol_id), l2 AS (SELECT DISTINCT changeset_id, caller AS symbol_id FROM l1 JOIN e ON e.callee = l1.symbol_id), "
    "l3 AS (SELECT DISTINCT changeset_id, caller AS symbol_id FROM l2 JOIN e ON e.callee = l2.symbol_id), u AS (SELECT *, 0 AS depth FROM ch UNION ALL SELECT *, 1 FROM l1 UNION ALL SELECT *, 2 FROM l2 UNION ALL SELECT *, 3 FROM l3), "
    "near AS (SELECT changeset_id, symbol_id, min(depth) AS depth FROM u GROUP BY 1, 2)"
)
_REFS = f"{_G}, refs AS (SELECT DISTINCT callee AS symbol_id, path FROM e JOIN s ON s.symbol_id = e.caller UNION SELECT symbol_id, path FROM s)"
_REFRESH = (
    f"WITH {_REFS}, dirty AS (SELECT DISTINCT path FROM (SELECT unnest(paths) AS path FROM changesets WHERE created_at >= TIMESTAMPTZ '2025-09-01 00:00:00+00' AND NOT is_fresh_instance) WHERE path IS NOT NULL), "
    "hit AS (SELECT symbol_id FROM symbols WHERE path IN (SELECT path FROM dirty)), fresh AS (SELECT path FROM refs WHERE symbol_id IN (SELECT symbol_id FROM hit) UNION SELECT path FROM dirty)"
)
_IMPACT = (
    f"WITH {_G}, k1 AS (SELECT DISTINCT callee AS seed, caller AS symbol_id FROM e), k2 AS (SELECT DISTINCT seed, e.caller AS symbol_id FROM k1 JOIN e ON e.callee = k1.symbol_id), k AS (SELECT * FROM k1 UNION SELECT * FROM k2), "
    "imp AS (SELECT seed AS symbol_id, count(*) AS callers, round(log2(1 + count(*)) / log2(1 + (SELECT count(*) FROM s)), 6) AS impact FROM k WHERE seed <> symbol_id GROUP BY 1)"
)

SQL = {
    "graph_edges": f"WITH {_G} SELECT caller, callee FROM e",
    "unresolved_callees": "SELECT callee, count(DISTINCT caller) AS callers FROM edges WHERE callee NOT IN (SELECT symbol_id FROM symbols WHERE symbol_id IS NOT NULL) GROUP BY 1",
    "symbol_cardinalities": "SELECT repo_id, count(DISTINCT symbol_id) AS symbols, count(DISTINCT path) AS paths FROM symbols GROUP BY 1",
    "degree_centrality": f"{_DEG} SELECT symbol_id, degree FROM deg",
    "centrality_tier": f"{_DEG}, v AS (SELECT list_sort(list(degree)) AS l FROM deg), q AS (SELECT CASE WHEN len(l) < 4 THEN l[1] ELSE l[len(l) // 4 + 1] END AS q1, CASE WHEN len(l) < 4 THEN l[len(l)] ELSE l[len(l) * 3 // 4 + 1] END AS q3 FROM v) "
    "SELECT symbol_id, degree, CASE WHEN degree >= q3 THEN 'high' WHEN degree <= q1 THEN 'low' ELSE 'medium' END AS tier FROM deg, q",
    "changed_symbols": f"WITH {_CH} SELECT changeset_id, symbol_id FROM ch",
    "callers_bounded": f"{_NEAR} SELECT changeset_id, symbol_id, depth FROM near WHERE depth > 0",
    "invalidation_plan": f"{_NEAR}, p AS (SELECT changeset_id, coalesce(y.path, split_part(n.symbol_id, '::', 1)) AS path FROM near n LEFT JOIN (SELECT DISTINCT symbol_id, path FROM symbols) y USING (symbol_id) UNION SELECT changeset_id, path FROM (SELECT changeset_id, unnest(paths) AS path FROM changesets) WHERE path IS NOT NULL), "
    "m AS (SELECT changeset_id, CASE WHEN coalesce(is_fresh_instance, false) THEN 'sweep' WHEN coalesce(len(list_filter(paths, lambda x: x IS NOT NULL)), 0) = 0 THEN 'empty' ELSE 'bounded' END AS mode FROM changesets) "
    "SELECT changeset_id, mode, CASE WHEN mode = 'bounded' THEN (SELECT count(*) FROM near n WHERE n.changeset_id = m.changeset_id) ELSE 0 END AS symbols, CASE WHEN mode = 'bounded' THEN (SELECT count(*) FROM p WHERE p.changeset_id = m.changeset_id) ELSE 0 END AS files FROM m",
    "reverse_refs": f"WITH {_REFS} SELECT symbol_id, path FROM refs",
    "refresh_set": f"{_REFRESH} SELECT DISTINCT path FROM fresh",
    "sidecar_merge": f"{_REFRESH} SELECT path, symbol_id, CASE WHEN path IN (SELECT path FROM fresh) THEN 'fresh' ELSE 'kept' END AS origin FROM refs",
    "importers_top3": f"WITH {_G}, r AS (SELECT caller, callee, row_number() OVER (PARTITION BY callee ORDER BY caller) AS rn FROM e) SELECT * FROM r WHERE rn <= 3",
    "shard_documents": "WITH s AS (SELECT DISTINCT repo_id, path, name, kind, start_line FROM symbols WHERE symbol_id IS NOT NULL), t AS (SELECT *, concat_ws(':', lpad(start_line::varchar, 6, '0'), kind, name) AS x FROM s) "
    "SELECT repo_id, path, count(*) AS n, string_agg(x, ',' ORDER BY x) AS document FROM t GROUP BY 1, 2",
    "impact_signal": f"{_IMPACT} SELECT symbol_id, callers, impact FROM imp",
    "priority_score": f"{_IMPACT}, pf AS (SELECT y.repo_id, y.path, max(impact) AS impact FROM imp JOIN (SELECT DISTINCT symbol_id, repo_id, path FROM symbols) y USING (symbol_id) GROUP BY 1, 2), "
    r"f AS (SELECT finding_key, repo_id, evidence.file AS path, lower(regexp_replace(finding_id, '^\s+|\s+$', '', 'g')) AS fid, batch_no, confidence_score FROM findings WHERE finding_key IS NOT NULL), "
    "w AS (SELECT fid, min(batch_no) AS first FROM f WHERE fid IS NOT NULL GROUP BY 1), j AS (SELECT f.*, coalesce(pf.impact, 0) AS imp, CASE WHEN f.batch_no > w.first THEN 0.0::double ELSE 1.0::double END AS nov FROM f LEFT JOIN pf ON pf.repo_id = f.repo_id AND pf.path = f.path LEFT JOIN w ON w.fid = f.fid) "
    "SELECT finding_key, imp AS impact, nov AS novelty, round(0.35::double * imp + 0.25::double * 0.5::double + 0.20::double * coalesce(confidence_score, 0) + 0.10::double * nov + 0.10::double * 0.5::double, 6) AS priority FROM j",
}
