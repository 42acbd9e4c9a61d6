"""Queries that relate source text, symbols and changes: occurrences, dead names, modes, roll-ups of folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import scalars as S
from quern.sources.tables import table, texts

WORD = "([A-Za-z_][A-Za-z0-9_]*)"


def _words(spark: SparkSession, d: str) -> DataFrame:
    """(repo_id, relpath, name, n): identifiers of each file, counted per file before anything is shuffled on names."""
    t = texts(spark, d).where("relpath is not null").select("repo_id", "relpath", F.explode(F.regexp_extract_all("text", F.lit(WORD))).alias("name"))
    return t.groupBy("repo_id", "relpath", "name").agg(F.count(F.lit(1)).alias("n"))


def name_occurrences(spark: SparkSession, d: str) -> DataFrame:
    """How often the name of each symbol of a repository occurs in its files, and in how many."""
    names = table(spark, d, "symbols").where("name is not null").select("repo_id", "name").distinct()
    return _words(spark, d).join(names, ["repo_id", "name"]).groupBy("repo_id", "name").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("files"))


def shared_names(spark: SparkSession, d: str) -> DataFrame:
    """Symbol names that several repositories declare."""
    return table(spark, d, "symbols").where("name is not null").groupBy("name").agg(F.countDistinct("repo_id").alias("repos"), F.countDistinct("symbol_id").alias("symbols")).where("repos > 1")


def replace_first(spark: SparkSession, d: str) -> DataFrame:
    """The first two lines with TODO done, of files that have some, and how many there were."""
    t = texts(spark, d)
    parts = F.split("text", "TODO")
    n = F.size(parts) - 1
    joined = F.concat(F.array_join(F.slice(parts, 1, 3), "DONE"), F.when(n > 2, F.concat(F.lit("TODO"), F.array_join(F.slice(parts, F.lit(4), F.greatest(n - 2, F.lit(1))), "TODO"))).otherwise(""))
    return t.where(n > 0).select("file_id", n.alias("available"), F.sha2(joined, 256).alias("hash"))


def change_modes(spark: SparkSession, d: str) -> DataFrame:
    """How each changeset is taken: sweep (fresh), empty, partial (unknown files among its paths) or exact."""
    known = table(spark, d, "parse_results").where("relpath is not null").select("repo_id", F.col("relpath").alias("path"), F.lit(1).alias("known")).distinct()
    c = table(spark, d, "changesets")
    p = c.select("changeset_id", "repo_id", F.explode("paths").alias("path")).where("path is not null").distinct().join(known, ["repo_id", "path"], "left")
    n = p.groupBy("changeset_id").agg(F.count(F.lit(1)).alias("paths"), F.count("known").alias("known"))
    j = c.select("changeset_id", F.coalesce("is_fresh_instance", F.lit(False)).alias("fresh"), S.tidy(F.col("watcher_confidence")).alias("confidence")).join(n, "changeset_id", "left").fillna(0, ["paths", "known"])
    mode = F.when(F.col("fresh"), "sweep").when(F.col("paths") == 0, "empty").when(F.col("known") < F.col("paths"), "partial").otherwise("exact")
    return j.select("changeset_id", mode.alias("mode"), "confidence", "paths", "known")


def folder_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Files and bytes by top folder and language, with subtotals."""
    f = table(spark, d, "parse_results").where("relpath is not null").select(F.substring_index("relpath", "/", 1).alias("top"), S.language(F.col("relpath")).alias("lang"), F.length("source_bytes").alias("n"))
    return f.rollup("top", "lang").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("bytes")).select(F.coalesce("top", F.lit("*")).alias("top"), F.coalesce("lang", F.lit("*")).alias("lang"), "files", "bytes")


def files_without_symbols(spark: SparkSession, d: str) -> DataFrame:
    has = table(spark, d, "symbols").select("repo_id", F.col("path").alias("relpath"))
    return table(spark, d, "parse_results").where("relpath is not null").select("repo_id", "relpath").distinct().join(has, ["repo_id", "relpath"], "left_anti")


def enclosing_symbols(spark: SparkSession, d: str) -> DataFrame:
    """For each finding the innermost symbol whose lines hold it (interval join on file, least span first)."""
    s = table(spark, d, "symbols").where("end_line is not null").select("repo_id", "path", "symbol_id", "start_line", "end_line").distinct()
    f = table(spark, d, "findings").where("finding_key is not null and evidence.line is not null").select("finding_key", "repo_id", F.col("evidence.file").alias("path"), F.col("evidence.line").alias("line"))
    j = f.join(s, ["repo_id", "path"]).where("line between start_line and end_line")
    return j.groupBy("finding_key").agg(F.min_by("symbol_id", F.struct(F.col("end_line") - F.col("start_line"), "symbol_id")).alias("symbol_id"))


def symbol_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Lines between a symbol's end and the start of the next in its file."""
    s = table(spark, d, "symbols").where("symbol_id is not null and start_line is not null").select("repo_id", "path", "symbol_id", "start_line", "end_line").distinct()
    w = Window.partitionBy("repo_id", "path").orderBy("start_line", "symbol_id", "end_line")  # a window per file
    return s.withColumn("gap", F.lead("start_line").over(w) - F.col("end_line") - 1).where("gap is not null").select("symbol_id", "start_line", "gap")


QUERIES = {f.__name__: f for f in (name_occurrences, shared_names, replace_first, change_modes, folder_rollup, files_without_symbols, enclosing_symbols, symbol_gaps)}

_T = "texts AS (SELECT *, array_to_string(lines, chr(10)) AS text FROM parse_results WHERE lines IS NOT NULL)"
_OCC = (
    f"WITH {_T}, w AS (SELECT repo_id, relpath, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM texts WHERE relpath IS NOT NULL), o AS (SELECT w.repo_id, w.name, count(*) AS occurrences, count(DISTINCT relpath) AS files FROM w "
    "JOIN (SELECT DISTINCT repo_id, name FROM symbols WHERE name IS NOT NULL) s ON s.repo_id = w.repo_id AND s.name = w.name GROUP BY 1, 2)"
)
_LANG = r"CASE e " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.LANGUAGES.items()) + " WHEN '' THEN 'unknown' ELSE substr(e, 2) END"

SQL = {
    "name_occurrences": f"{_OCC} SELECT repo_id, name, occurrences, files FROM o",
    "shared_names": "SELECT name, count(DISTINCT repo_id) AS repos, count(DISTINCT symbol_id) AS symbols FROM symbols WHERE name IS NOT NULL GROUP BY 1 HAVING count(DISTINCT repo_id) > 1",
    "replace_first": f"WITH {_T}, p AS (SELECT file_id, string_split(text, 'TODO') AS s FROM texts) SELECT file_id, len(s) - 1 AS available, sha256(array_to_string(s[1:3], 'DONE') || CASE WHEN len(s) > 3 THEN 'TODO' || array_to_string(s[4:], 'TODO') ELSE '' END) AS hash FROM p WHERE len(s) > 1",
    "change_modes": r"WITH p AS (SELECT DISTINCT changeset_id, repo_id, path FROM (SELECT changeset_id, repo_id, unnest(paths) AS path FROM changesets) WHERE path IS NOT NULL), n AS (SELECT changeset_id, count(*) AS paths, count(*) FILTER (EXISTS (SELECT 1 FROM parse_results r WHERE r.repo_id = p.repo_id AND r.relpath = p.path)) AS known FROM p GROUP BY 1) "
    r"SELECT c.changeset_id, CASE WHEN coalesce(is_fresh_instance, false) THEN 'sweep' WHEN coalesce(paths, 0) = 0 THEN 'empty' WHEN known < paths THEN 'partial' ELSE 'exact' END AS mode, lower(regexp_replace(watcher_confidence, '^\s+|\s+$', '', 'g')) AS confidence, coalesce(n.paths, 0) AS paths, coalesce(known, 0) AS known FROM (SELECT changeset_id, is_fresh_instance, watcher_confidence FROM changesets) c LEFT JOIN n USING (changeset_id)",
    "folder_rollup": rf"WITH f AS (SELECT split_part(relpath, '/', 1) AS top, lower(regexp_extract(relpath, '(\.[^./\\]+)$', 1)) AS e, octet_length(source_bytes) AS n FROM parse_results WHERE relpath IS NOT NULL), g AS (SELECT top, {_LANG} AS lang, n FROM f) SELECT coalesce(top, '*') AS top, coalesce(lang, '*') AS lang, count(*) AS files, sum(n) AS bytes FROM g GROUP BY ROLLUP (top, lang)",
    "files_without_symbols": "SELECT DISTINCT repo_id, relpath FROM parse_results p WHERE relpath IS NOT NULL AND NOT EXISTS (SELECT 1 FROM symbols s WHERE s.repo_id = p.repo_id AND s.path = p.relpath)",
    "enclosing_symbols": "SELECT finding_key, arg_min(symbol_id, (end_line - start_line, symbol_id)) AS symbol_id FROM findings f JOIN symbols s ON s.repo_id = f.repo_id AND s.path = f.evidence.file AND f.evidence.line BETWEEN s.start_line AND s.end_line WHERE finding_key IS NOT NULL GROUP BY 1",
    "symbol_gaps": "WITH s AS (SELECT DISTINCT repo_id, path, symbol_id, start_line, end_line FROM symbols WHERE symbol_id IS NOT NULL AND start_line IS NOT NULL), g AS (SELECT symbol_id, start_line, lead(start_line) OVER (PARTITION BY repo_id, path ORDER BY start_line, symbol_id, end_line NULLS FIRST) - end_line - 1 AS gap FROM s) SELECT * FROM g WHERE gap IS NOT NULL",
}
