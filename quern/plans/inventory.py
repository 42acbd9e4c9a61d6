"""Queries on the file inventory (parse_results): rows, signals, chunks, snapshots, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import scalars as S
from quern.operators import chunks, graph, ranking
from quern.sources.tables import table, texts

AS_OF = "2025-11-01"
CUTOFF = "2025-06-01"

def file_inventory(spark: SparkSession, d: str) -> DataFrame:
    f = texts(spark, d)
    p = F.col("relpath")
    return f.where(S.is_source(p) & ~S.is_hidden(p) & ~S.is_generated(p)).select(
        "file_id", "repo_id", "relpath", S.extension(p).alias("extension"), S.language(p).alias("language"), S.is_test(p).alias("is_test"), F.length("source_bytes").alias("bytes"),
        S.line_count(F.col("text")).alias("line_count"), F.substring(F.sha2("source_bytes", 256), 1, 16).alias("content_hash"), (F.size(F.split(p, "/")) - 1).alias("depth"),
    )


def content_duplicates(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "parse_results").where("source_bytes is not null")
    return f.groupBy(F.sha2("source_bytes", 256).alias("hash")).agg(F.count(F.lit(1)).alias("files"), F.countDistinct("repo_id").alias("repos"), F.min("file_id").alias("first_file")).where("files > 1")


def line_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of 200 lines that share 40; files of up to 260 lines are one."""
    f = table(spark, d, "parse_results").where("lines is not null")
    return chunks.line_chunks(f.select("file_id", F.size("lines").alias("n")))


def chunk_sampling(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of each file that are sent on: all of up to six; of files with more only those that no earlier delivery
    of the path had with the same text, at most six of them, evenly spaced."""
    f = table(spark, d, "parse_results").where("lines is not null").select("file_id", "repo_id", "relpath", "last_seen_at", "lines")
    each = line_chunks(spark, d)
    many = each.groupBy("file_id").agg(F.count(F.lit(1)).alias("all")).where("all > 6").select("file_id")
    few = each.join(many, "file_id", "left_anti")
    text = each.join(f, "file_id").select("file_id", "repo_id", "relpath", "last_seen_at", "chunk_no", "first_line", "last_line", F.sha2(F.array_join(F.slice("lines", F.col("first_line"), F.col("last_line") - F.col("first_line") + 1), "\n"), 256).alias("hash"))
    first = text.where("relpath is not null").groupBy("repo_id", "relpath", "chunk_no", "hash").agg(F.min(F.struct("last_seen_at", "file_id")).alias("at"))  # the delivery that had a chunk first
    unseen = text.join(many, "file_id", "left_semi").join(first, ["repo_id", "relpath", "chunk_no", "hash"], "left").where("at is null or at.file_id = file_id").select("file_id", "chunk_no", "first_line", "last_line")
    return few.unionByName(chunks.sample_even(unseen, "file_id", "chunk_no", 6))


def read_range(spark: SparkSession, d: str) -> DataFrame:
    """Lines 3 to 7 of each file, numbered."""
    f = table(spark, d, "parse_results").where("lines is not null")
    part = F.transform(F.slice("lines", 3, 5), lambda x, i: F.concat((i + 3).cast("string"), F.lit(": "), x))
    return f.where(F.size("lines") >= 3).select("file_id", F.array_join(part, "\n").alias("text"))


def prompt_truncation(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "parse_results").where("lines is not null")
    n = F.size("lines")
    cut = F.array_join(F.slice("lines", 1, 40), "\n")
    return f.select("file_id", F.when(n > 40, F.concat(cut, F.lit("\n(truncated, "), n.cast("string"), F.lit(" total lines)"))).otherwise(cut).alias("prompt"))


def line_search(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "parse_results").where("lines is not null")
    return f.select("file_id", F.posexplode("lines").alias("pos", "line")).where(F.col("line").rlike("TODO|FIXME")).select("file_id", (F.col("pos") + 1).alias("line_no"), "line")


def latest(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots by repo_id, relpath: what was first seen before the cut-off, and what was last seen after it."""
    f = table(spark, d, "parse_results").where("relpath is not null")
    newest = lambda x: x.groupBy("repo_id", "relpath").agg(F.max_by(F.sha2("source_bytes", 256), F.struct("last_seen_at", "file_id")).alias("hash"))
    return newest(f.where(f.first_seen_at < F.lit(CUTOFF).cast("timestamp"))), newest(f.where(f.last_seen_at >= F.lit(CUTOFF).cast("timestamp")))


def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    before, now = latest(spark, d)
    return graph.snapshot_diff(before, now, ["repo_id", "relpath"], "hash")


def missing_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """Files of the old snapshot that the new one lacks, kept while seen in the 200 days before the time of the query."""
    before, now = latest(spark, d)
    seen = table(spark, d, "parse_results").groupBy("repo_id", "relpath").agg(F.max("last_seen_at").alias("seen"))
    lost = before.join(now, ["repo_id", "relpath"], "left_anti").join(seen, ["repo_id", "relpath"])
    return lost.where(F.col("seen") >= F.lit(AS_OF).cast("timestamp") - F.expr("interval 200 days")).select("repo_id", "relpath", "hash")


def neighbor_activity(spark: SparkSession, d: str) -> DataFrame:
    """Unchanged files of a folder in which something else changed."""
    state = snapshot_diff(spark, d).where("state in ('same', 'dirty', 'added')").withColumn("folder", S.parent(F.col("relpath")))
    active = state.where("state <> 'same'").select("repo_id", "folder").distinct()
    return state.where("state = 'same'").join(active, ["repo_id", "folder"], "left_semi").select("repo_id", "relpath", "folder")


def ttl_staleness(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "parse_results").where("relpath is not null")
    age = (F.unix_micros(F.lit(AS_OF).cast("timestamp")) - F.unix_micros("last_seen_at")) / 86400e6
    return f.select("file_id", S.ttl_days(F.col("relpath")).alias("ttl"), F.coalesce(age >= S.ttl_days(F.col("relpath")), F.lit(True)).alias("stale"))


def same_folder_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """Of each folder of a repository the first five files by name."""
    f = table(spark, d, "parse_results").where("relpath is not null").select("repo_id", "relpath", S.parent(F.col("relpath")).alias("folder")).distinct()
    rn = F.row_number().over(Window.partitionBy("repo_id", "folder").orderBy("relpath"))
    return f.withColumn("rn", rn).where("rn <= 5")


def test_stems(spark: SparkSession, d: str) -> DataFrame:
    """Stems that test files stand for, and how many files of the stem are no tests."""
    f = table(spark, d, "parse_results").where("relpath is not null").select("repo_id", "relpath").distinct()
    name = F.regexp_replace(F.regexp_replace(S.stem(F.col("relpath")), "^test_", ""), r"_test$|\.test$|\.spec$", "")
    f = f.select("repo_id", name.alias("stem"), S.is_test(F.col("relpath")).alias("is_test"))
    return f.groupBy("repo_id", "stem").agg(F.count_if("is_test").alias("tests"), F.count_if(~F.col("is_test")).alias("others")).where("tests > 0")


def longest_prefix_owner(spark: SparkSession, d: str) -> DataFrame:
    """The nearest folder above each file that holds a Go file, by an equi-join on all its ancestors."""
    f = table(spark, d, "parse_results").where("relpath is not null").select("repo_id", "relpath").distinct()
    roots = f.where(S.extension(F.col("relpath")) == ".go").select("repo_id", S.parent(F.col("relpath")).alias("root")).distinct()
    parts = F.split("relpath", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    each = f.where(F.col("relpath").contains("/")).select("repo_id", "relpath", F.explode(ups).alias("root"))
    return each.join(roots, ["repo_id", "root"]).groupBy("repo_id", "relpath").agg(F.max_by("root", F.length("root")).alias("root"))


def glob_suppression(spark: SparkSession, d: str) -> DataFrame:
    """Files that a glob (fnmatch, * crossing /) suppresses, with the first such glob."""
    globs = spark.createDataFrame([(1, "src/*/test_*.py"), (2, "*/vendor/*"), (3, "lib/s?at*"), (4, "*.min.js")], "no int, glob string").withColumn("re", S.glob_to_regex(F.col("glob")))
    f = table(spark, d, "parse_results").where("relpath is not null").select("file_id", "relpath")
    return f.join(F.broadcast(globs), F.expr("relpath rlike re")).groupBy("file_id").agg(F.min_by("glob", "no").alias("glob"))  # four literal rows


def churn(spark: SparkSession, d: str) -> DataFrame:
    """Changes per repository and path in the 90 days before the time of the query."""
    c = table(spark, d, "changesets").where(F.col("created_at").between(F.lit(AS_OF).cast("timestamp") - F.expr("interval 90 days"), F.lit(AS_OF).cast("timestamp")))
    return c.select("repo_id", F.explode("paths").alias("path")).where("path is not null").groupBy("repo_id", "path").agg(F.count(F.lit(1)).alias("changes"))


def change_bursts(spark: SparkSession, d: str) -> DataFrame:
    """Repositories whose last five changesets touched more than ten paths in all, two of them at least non-empty."""
    c = table(spark, d, "changesets").select("repo_id", "changeset_id", "created_at", F.coalesce(F.size(F.array_compact("paths")), F.lit(0)).alias("n")).withColumn("n", F.greatest("n", F.lit(0)))
    last = c.withColumn("rn", F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc_nulls_last("created_at"), F.desc("changeset_id")))).where("rn <= 5")
    return last.groupBy("repo_id").agg(F.sum("n").alias("paths"), F.count_if(F.col("n") > 0).alias("filled")).where("paths > 10 and filled >= 2")


def recent_selections(spark: SparkSession, d: str) -> DataFrame:
    """Per path its last twelve changes, and how many of them lie in the 60 days before the last change of all."""
    c = table(spark, d, "changesets").select("repo_id", F.explode("paths").alias("path"), F.unix_micros("created_at").alias("t")).where("path is not null and t is not null")
    top = c.agg(F.max("t").alias("top"))
    rn = F.row_number().over(Window.partitionBy("repo_id", "path").orderBy(F.desc("t")))
    last = c.withColumn("rn", rn).where("rn <= 12").crossJoin(F.broadcast(top))
    return last.groupBy("repo_id", "path").agg(F.count(F.lit(1)).alias("kept"), F.count_if(F.col("t") >= F.col("top") - 60 * 86_400_000_000).alias("recent"))


def selection_gini(spark: SparkSession, d: str) -> DataFrame:
    """How unevenly changes fall on the paths of each repository."""
    return ranking.gini(churn(spark, d), ["repo_id"], "changes")


QUERIES = {
    f.__name__: f
    for f in (
        file_inventory, content_duplicates, line_chunks, chunk_sampling, read_range, prompt_truncation, line_search, snapshot_diff, missing_carry_forward,
        neighbor_activity, ttl_staleness, same_folder_neighbors, test_stems, longest_prefix_owner, glob_suppression, churn, change_bursts, recent_selections, selection_gini,
    )
}

_EXT = r"lower(regexp_extract({p}, '(\.[^./\\]+)$', 1))"
_BASE = r"regexp_extract({p}, '([^/]*)$', 1)"
_TEST = (
    r"(regexp_matches(lower({p}), '(^|/)(tests?|__tests__|spec)(/|$)') OR regexp_matches(lower(regexp_extract({p}, '([^/]*)$', 1)), '^test_|\.test|\.spec') "
    r"OR regexp_matches(lower(regexp_replace(regexp_extract({p}, '([^/]*)$', 1), '(.)\.[^.]*$', '\1')), '_(test|spec)$'))"
)
_PARENT = r"(CASE WHEN regexp_extract({p}, '^(.*)/[^/]*$', 1) = '' THEN '.' ELSE regexp_extract({p}, '^(.*)/[^/]*$', 1) END)"
_TEXTS = "texts AS (SELECT *, array_to_string(lines, chr(10)) AS text FROM parse_results WHERE lines IS NOT NULL)"
_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_COUNT = rf"(CASE WHEN text = '' THEN 0 ELSE len(regexp_split_to_array(text, '{_ENDS}')) - CASE WHEN regexp_matches(text, '({_ENDS})\z') THEN 1 ELSE 0 END END)"


def _sql(s: str, p: str = "relpath") -> str:
    for k, v in {"@EXT": _EXT, "@BASE": _BASE, "@TEST": _TEST, "@PARENT": _PARENT}.items():
        s = s.replace(k, v.replace("{p}", p))
    return s.replace("@TEXTS", _TEXTS).replace("@COUNT", _COUNT).replace("@ASOF", f"TIMESTAMPTZ '{AS_OF} 00:00:00+00'").replace("@CUT", f"TIMESTAMPTZ '{CUTOFF} 00:00:00+00'")


_CASE_LANG = "CASE @EXT " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.LANGUAGES.items()) + " WHEN '' THEN 'unknown' ELSE substr(@EXT, 2) END"
_CHUNKS = (
    "WITH f AS (SELECT file_id, repo_id, relpath, last_seen_at, lines, len(lines) AS n FROM parse_results WHERE lines IS NOT NULL), c AS (SELECT file_id, 1 AS chunk_no, 1 AS first_line, n AS last_line FROM f WHERE n <= 260 AND n > 0 UNION ALL "
    "SELECT file_id, k + 1, k * 160 + 1, least(n, k * 160 + 200) FROM f, range(0, 100000) r(k) WHERE n > 260 AND (k = 0 OR (k - 1) * 160 + 200 < n))"
)
_SNAP = (
    "WITH a AS (SELECT repo_id, relpath, arg_max(sha256(source_bytes), (last_seen_at, file_id)) AS hash FROM parse_results WHERE relpath IS NOT NULL AND first_seen_at < @CUT GROUP BY 1, 2), "
    "b AS (SELECT repo_id, relpath, arg_max(sha256(source_bytes), (last_seen_at, file_id)) AS hash FROM parse_results WHERE relpath IS NOT NULL AND last_seen_at >= @CUT GROUP BY 1, 2), "
    "d AS (SELECT coalesce(a.repo_id, b.repo_id) AS repo_id, coalesce(a.relpath, b.relpath) AS relpath, CASE WHEN a.relpath IS NULL THEN 'added' WHEN b.relpath IS NULL THEN 'deleted' "
    "WHEN a.hash IS NOT DISTINCT FROM b.hash THEN 'same' ELSE 'dirty' END AS state FROM a FULL JOIN b ON a.repo_id = b.repo_id AND a.relpath = b.relpath)"
)
_CHURN = "churn AS (SELECT repo_id, path, count(*) AS changes FROM (SELECT repo_id, unnest(paths) AS path FROM changesets WHERE created_at BETWEEN @ASOF - INTERVAL 90 DAY AND @ASOF) WHERE path IS NOT NULL GROUP BY 1, 2)"
SQL = {
    k: _sql(v)
    for k, v in {
        "file_inventory": rf"WITH @TEXTS SELECT file_id, repo_id, relpath, @EXT AS extension, {_CASE_LANG} AS language, @TEST AS is_test, octet_length(source_bytes) AS bytes, @COUNT AS line_count, substr(sha256(source_bytes), 1, 16) AS content_hash, "
        r"len(string_split(relpath, '/')) - 1 AS depth FROM texts WHERE NOT regexp_matches(relpath, '(^|/)\.[^/]') AND NOT regexp_matches(relpath, '\.generated\.|\.g\.|\.pb\.|node_modules/|dist/|build/') AND @EXT IN (" + ", ".join(f"'{k}'" for k in S.LANGUAGES) + ")",
        "content_duplicates": "SELECT sha256(source_bytes) AS hash, count(*) AS files, count(DISTINCT repo_id) AS repos, min(file_id) AS first_file FROM parse_results WHERE source_bytes IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
        "line_chunks": _CHUNKS + " SELECT file_id, chunk_no, first_line, last_line FROM c",
        "chunk_sampling": _CHUNKS + ", m AS (SELECT file_id FROM c GROUP BY 1 HAVING count(*) > 6), t AS (SELECT c.*, f.repo_id, f.relpath, f.last_seen_at, array_to_string(f.lines[first_line:last_line], chr(10)) AS x FROM c JOIN f USING (file_id)), "
        "u AS (SELECT * FROM t WHERE file_id IN (SELECT file_id FROM m) AND NOT EXISTS (SELECT 1 FROM t o WHERE o.repo_id = t.repo_id AND o.relpath = t.relpath AND o.chunk_no = t.chunk_no AND o.x = t.x AND (o.last_seen_at, o.file_id) < (t.last_seen_at, t.file_id))), "
        "v AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY chunk_no) - 1 AS i, count(*) OVER (PARTITION BY file_id) AS k FROM u) SELECT file_id, chunk_no, first_line, last_line FROM c WHERE file_id NOT IN (SELECT file_id FROM m) "
        "UNION ALL SELECT file_id, chunk_no, first_line, last_line FROM v WHERE k <= 6 OR i IN (SELECT round_even((k - 1) * j / 5.0, 0)::int FROM range(0, 6) r(j))",
        "read_range": "SELECT file_id, array_to_string([(i + 2) || ': ' || lines[i + 2] FOR i IN range(1, least(6, len(lines) - 1))], chr(10)) AS text FROM parse_results WHERE lines IS NOT NULL AND len(lines) >= 3",
        "prompt_truncation": "SELECT file_id, array_to_string(lines[1:40], chr(10)) || CASE WHEN len(lines) > 40 THEN chr(10) || '(truncated, ' || len(lines) || ' total lines)' ELSE '' END AS prompt FROM parse_results WHERE lines IS NOT NULL",
        "line_search": "SELECT file_id, i AS line_no, lines[i] AS line FROM parse_results, range(1, 100000) r(i) WHERE lines IS NOT NULL AND i <= len(lines) AND regexp_matches(lines[i], 'TODO|FIXME')",
        "snapshot_diff": _SNAP + " SELECT repo_id, relpath, state FROM d",
        "missing_carry_forward": _SNAP + ", s AS (SELECT repo_id, relpath, max(last_seen_at) AS seen FROM parse_results GROUP BY 1, 2) SELECT a.repo_id, a.relpath, a.hash FROM a JOIN d USING (repo_id, relpath) JOIN s USING (repo_id, relpath) WHERE d.state = 'deleted' AND seen >= @ASOF - INTERVAL 200 DAY",
        "neighbor_activity": _SNAP + ", e AS (SELECT *, @PARENT AS folder FROM d WHERE state <> 'deleted') SELECT repo_id, relpath, folder FROM e WHERE state = 'same' AND EXISTS (SELECT 1 FROM e x WHERE x.repo_id = e.repo_id AND x.folder = e.folder AND x.state <> 'same')",
        "ttl_staleness": "WITH t AS (SELECT file_id, last_seen_at, CASE WHEN @TEST THEN 14 WHEN regexp_matches(relpath, '^(src|lib|app|pkg)/') THEN 7 ELSE 21 END AS ttl FROM parse_results WHERE relpath IS NOT NULL) "
        "SELECT file_id, ttl, coalesce((epoch_us(@ASOF) - epoch_us(last_seen_at)) / 86400e6 >= ttl, true) AS stale FROM t",
        "same_folder_neighbors": "WITH f AS (SELECT DISTINCT repo_id, relpath, @PARENT AS folder FROM parse_results WHERE relpath IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY repo_id, folder ORDER BY relpath) AS rn FROM f) SELECT * FROM r WHERE rn <= 5",
        "test_stems": r"WITH f AS (SELECT DISTINCT repo_id, relpath FROM parse_results WHERE relpath IS NOT NULL), g AS (SELECT repo_id, regexp_replace(regexp_replace(regexp_replace(@BASE, '(.)\.[^.]*$', '\1'), '^test_', ''), '_test$|\.test$|\.spec$', '') AS stem, @TEST AS t FROM f) "
        "SELECT repo_id, stem, count(*) FILTER (t) AS tests, count(*) FILTER (NOT t) AS others FROM g GROUP BY 1, 2 HAVING count(*) FILTER (t) > 0",
        "longest_prefix_owner": "WITH f AS (SELECT DISTINCT repo_id, relpath FROM parse_results WHERE relpath IS NOT NULL), r AS (SELECT DISTINCT repo_id, @PARENT AS root FROM f WHERE @EXT = '.go') "
        "SELECT f.repo_id, f.relpath, arg_max(r.root, length(r.root)) AS root FROM f JOIN r ON r.repo_id = f.repo_id AND starts_with(f.relpath, r.root || '/') GROUP BY 1, 2",
        "glob_suppression": "WITH g(no, pat) AS (VALUES (1, 'src/*/test_*.py'), (2, '*/vendor/*'), (3, 'lib/s?at*'), (4, '*.min.js')) SELECT file_id, arg_min(pat, no) AS glob FROM parse_results JOIN g ON relpath GLOB pat GROUP BY 1",
        "churn": f"WITH {_CHURN} SELECT repo_id, path, changes FROM churn",
        "change_bursts": "WITH c AS (SELECT repo_id, changeset_id, created_at, coalesce(len(list_filter(paths, lambda x: x IS NOT NULL)), 0) AS n, row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC NULLS LAST, changeset_id DESC) AS rn FROM changesets) "
        "SELECT repo_id, sum(n) AS paths, count(*) FILTER (n > 0) AS filled FROM c WHERE rn <= 5 GROUP BY 1 HAVING sum(n) > 10 AND count(*) FILTER (n > 0) >= 2",
        "recent_selections": "WITH c AS (SELECT repo_id, path, t FROM (SELECT repo_id, unnest(paths) AS path, epoch_us(created_at) AS t FROM changesets) WHERE path IS NOT NULL AND t IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY t DESC) AS rn FROM c) "
        "SELECT repo_id, path, count(*) AS kept, count(*) FILTER (t >= (SELECT max(t) FROM c) - 60 * 86400000000) AS recent FROM r WHERE rn <= 12 GROUP BY 1, 2",
        "selection_gini": f"WITH {_CHURN}, r AS (SELECT repo_id, changes, row_number() OVER (PARTITION BY repo_id ORDER BY changes) AS i, count(*) OVER (PARTITION BY repo_id) AS n, sum(changes) OVER (PARTITION BY repo_id) AS s FROM churn) "
        "SELECT repo_id, round(greatest(0, 2.0 * sum(i * changes) / (any_value(n) * any_value(s)) - (any_value(n) + 1.0) / any_value(n)), 6)::double AS gini FROM r GROUP BY 1",
    }.items()
}
