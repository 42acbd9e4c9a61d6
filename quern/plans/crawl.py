"""Planning of a crawl: text signals, the inventory with its history, crawl scores with reasons, frontier and choice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import scalars as S
from quern.operators import crawl, ranking
from quern.sources.tables import table, texts

AS_OF = "2025-09-20"
BATCH = 8

#: Fixed: patterns of the text signals in the order in which rows of a rule are numbered: (rule, severity, confidence,
#: most rows of a pattern, pattern).
SIGNALS = [
    ("secret_pattern", "critical", 0.96, 1, r"(?i)(api[_-]?key|secret|token|password)\s*[:=]\s*['\"][^'\"]{8,}['\"]"),
    ("secret_pattern", "critical", 0.96, 1, r"-----BEGIN (RSA|DSA|EC|OPENSSH|PGP) PRIVATE KEY-----"),
    ("risky_api", "high", 0.78, 3, r"\beval\s*\("),
    ("risky_api", "high", 0.78, 3, r"\bexec\s*\("),
    ("risky_api", "high", 0.78, 3, r"subprocess\.(Popen|run)\("),
    ("risky_api", "high", 0.78, 3, r"os\.system\s*\("),
    ("risky_api", "high", 0.78, 3, r"innerHTML\s*="),
    ("risky_api", "high", 0.78, 3, r"Runtime\.exec\s*\("),
    ("data_boundary", "medium", 0.61, 1, r"\b(jsonDecode|json\.loads|yaml\.load|pickle\.loads|marshal\.loads)\b"),
    ("data_boundary", "medium", 0.61, 1, r"\b(open|readAsString|read_text|write_text|writeAsString)\b"),
    ("data_boundary", "medium", 0.61, 1, r"\b(http\.|requests\.|fetch\(|aiohttp|urllib)\b"),
]
#: Of each pattern the words of which a text must have one; none where letter case varies.
WORDS = [(), ("PRIVATE KEY",), ("eval",), ("exec",), ("subprocess.",), ("os.system",), ("innerHTML",), ("Runtime.exec",), ("jsonDecode", ".load"), ("open", "read", "write"), ("http.", "requests.", "fetch(", "aiohttp", "urllib")]
#: Fixed: signals of whole files.
LARGE, MARKS, RISKY = 250, 3, 3


def _breaks(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def _hits(text: Column, no: int, most: int, pattern: str) -> Column:
    """An array of (no, hit, line) for the first matches of a pattern: a line is the number of line feeds before, plus one."""
    lead, hit = F.split(text, pattern, most + 1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    line = lambda k: _breaks(F.array_join(F.slice(lead, F.lit(1), k), "")) + _breaks(F.array_join(F.slice(hit, F.lit(1), k - 1), "")) + 1
    every = F.transform(F.sequence(F.lit(1), F.least(F.size(hit), F.lit(most))), lambda k: F.struct(F.lit(no).alias("no"), k.alias("hit"), line(k).alias("line")))
    words = WORDS[no]
    near = reduce(lambda a, b: a | b, [text.contains(w) for w in words]) if words else F.lit(True)  # plain search spares most texts the pattern
    return F.when(near & text.rlike(pattern), every)


def text_signals(spark: SparkSession, d: str) -> DataFrame:
    """Rows (file_id, no, hit, rule, severity, confidence, line) of each file's text: of secrets and data boundaries one a
    pattern, of risky calls three a file in the order of patterns and places; large files and files full of TODO and
    FIXME have one, of line 0."""
    f = texts(spark, d).select("file_id", "text")
    none = F.expr("cast(array() as array<struct<no:int,hit:int,line:int>>)")
    found = f.select("file_id", F.explode(F.concat(*[F.coalesce(_hits(F.col("text"), k, most, p), none) for k, (_, _, _, most, p) in enumerate(SIGNALS)])).alias("h")).select("file_id", "h.*")
    pick = lambda i: F.array(*[F.lit(s[i]) for s in SIGNALS])[F.col("no")]
    rows = found.select("file_id", "no", "hit", pick(0).alias("rule"), pick(1).alias("severity"), pick(2).alias("confidence"), "line")
    rn = F.row_number().over(Window.partitionBy("file_id", "rule").orderBy("no", "hit"))  # a file's rows of a rule: 18 at most
    rows = rows.withColumn("rn", rn).where((F.col("rule") != "risky_api") | (F.col("rn") <= RISKY)).drop("rn")
    whole = f.select("file_id", S.line_count(F.col("text")).alias("n"), (F.regexp_count("text", F.lit("TODO")) + F.regexp_count("text", F.lit("FIXME"))).alias("marks"))
    one = lambda when, no, rule, severity, confidence: whole.where(when).select(
        "file_id", F.lit(no).alias("no"), F.lit(1).alias("hit"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), F.lit(0).alias("line")
    )
    return rows.unionByName(one(F.col("n") >= LARGE, 11, "large_file", "medium", 0.58)).unionByName(one(F.col("marks") >= MARKS, 12, "deferred_work", "low", 0.5))


def signal_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per file: number of signals, highest severity, sum of severity ranks, highest confidence."""
    rank = S.lookup(S.SEVERITIES, F.col("severity"))
    g = text_signals(spark, d).groupBy("file_id").agg(F.count(F.lit(1)).alias("signals"), F.max_by("severity", rank).alias("max_severity"), F.sum(rank).alias("risk"), F.max("confidence").alias("confidence"))
    return g


def _at(days: int = 0) -> Column:
    return F.lit(AS_OF).cast("timestamp") - F.expr(f"interval {days} days")


def _touched(spark: SparkSession, d: str, days: int, name: str) -> DataFrame:
    """How many changesets of the days before the time of the query name a path."""
    c = table(spark, d, "changesets").where(F.col("created_at").between(_at(days), _at()))
    return c.select("repo_id", F.explode("paths").alias("relpath")).where("relpath is not null").groupBy("repo_id", "relpath").agg(F.count(F.lit(1)).alias(name))


def _inventory(spark: SparkSession, d: str) -> DataFrame:
    """The newest row of each path with its previous state, churn, findings and signals.

    The hash that was delivered with a row is that of the crawl before, last_seen_at the time of its review; rows without
    such a hash were never reviewed. A file without findings that was crawled before was clean.
    """
    p = table(spark, d, "parse_results").where("relpath is not null")
    text = F.array_join("lines", "\n")
    each = p.select("repo_id", "relpath", F.struct(F.col("last_seen_at").alias("crawled_at"), "file_id").alias("at"), F.struct(
        F.coalesce(S.line_count(text), F.lit(0)).alias("lines"), F.sha2("source_bytes", 256).alias("hash"), F.col("content_hash").alias("last_hash"), F.when(F.col("content_hash").isNotNull(), F.col("last_seen_at")).alias("reviewed_at"),
    ).alias("v"))
    new = each.groupBy("repo_id", "relpath").agg(F.max_by("v", "at").alias("v"), F.max("at").alias("at")).select("repo_id", "relpath", "at.crawled_at", "at.file_id", "v.*")
    rank = S.lookup(S.SEVERITIES, S.tidy(F.col("severity")))
    found = table(spark, d, "findings").groupBy("repo_id", F.col("evidence.file").alias("relpath")).agg(
        F.count(F.lit(1)).alias("findings"), F.count_if(~F.coalesce("status", F.lit("new")).isin("fixed", "permanently_failed")).alias("unresolved"), F.max(rank).alias("severity_rank")
    )
    j = new.join(found, ["repo_id", "relpath"], "left").join(_touched(spark, d, 30, "churn"), ["repo_id", "relpath"], "left").join(_touched(spark, d, 14, "selections"), ["repo_id", "relpath"], "left")
    j = j.join(signal_summary(spark, d).select("file_id", "signals", "risk", "confidence"), "file_id", "left").fillna(0, ["findings", "unresolved", "churn", "selections", "signals", "risk", "confidence"]).fillna(1, ["severity_rank"])
    j = j.withColumn("changed", F.coalesce(F.col("hash") != F.col("last_hash"), F.lit(True))).withColumn("folder", S.parent(F.col("relpath")))
    active = j.where(F.col("changed") | (F.col("crawled_at") >= _at(7))).select("repo_id", "folder").distinct().withColumn("active", F.lit(True))
    spread = ranking.gini(j, ["repo_id"], "selections")
    j = j.join(active, ["repo_id", "folder"], "left").join(spread, "repo_id", "left")
    return j.select(
        "repo_id", "relpath", "lines", "reviewed_at", "changed", "findings", "unresolved", "severity_rank", "churn", "selections", F.coalesce("gini", F.lit(0.0)).alias("gini"), "signals", "risk", "confidence",
        (F.coalesce("active", F.lit(False)) & ~F.col("changed")).alias("neighbor_changed"), (F.col("last_hash").isNotNull() & (F.col("findings") == 0)).alias("clean"),
    )


def crawl_inventory(spark: SparkSession, d: str) -> DataFrame:
    """``_inventory`` with the time of the last review in microseconds, 0 for never."""
    return _inventory(spark, d).withColumn("reviewed_us", F.coalesce(F.unix_micros("reviewed_at"), F.lit(0))).drop("reviewed_at")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return crawl.scored(_inventory(spark, d), _at())


def crawl_scores(spark: SparkSession, d: str) -> DataFrame:
    """The crawl priority of each path: the sum of the rules that fire, and how many do."""
    return _scored(spark, d).select("repo_id", "relpath", "score", F.size("reasons").alias("fired"))


def crawl_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The rules that fire, with what each adds."""
    return _scored(spark, d).select("repo_id", "relpath", F.explode("reasons").alias("r")).select("repo_id", "relpath", "r.rule", "r.impact")


def crawl_frontier(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty paths of each repository by score, findings and churn, ties by path."""
    w = Window.partitionBy("repo_id").orderBy(F.desc("score"), F.desc("findings"), F.desc("churn"), "relpath")
    return _scored(spark, d).withColumn("place", F.row_number().over(w)).where("place <= 20").select("repo_id", "relpath", "score", "place")


def diversity_topk(spark: SparkSession, d: str) -> DataFrame:
    """Per repository the eight paths of the next crawl: six from the front of the frontier, two of the rest, those
    never selected first, then by the oldest selection and by score. Changesets count as selections. Paths with a
    score below zero are reviewed only if chosen for diversity."""
    picked = table(spark, d, "changesets").where(F.col("created_at") <= _at()).select("repo_id", F.explode("paths").alias("relpath"), "created_at").where("relpath is not null")
    picked = picked.groupBy("repo_id", "relpath").agg(F.date_format(F.max("created_at"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_selected"))
    f = _scored(spark, d).select("repo_id", "relpath", "score", "findings", "churn").join(picked, ["repo_id", "relpath"], "left").fillna("", ["last_selected"])
    first = [F.desc("score"), F.desc("findings"), F.desc("churn"), F.asc("relpath")]
    rest = [(F.col("last_selected") != "").asc(), F.asc("last_selected"), F.desc("score"), F.asc("relpath")]
    got = ranking.topk_with_quota(f, ["repo_id"], ["relpath"], BATCH, first, rest)
    return got.select("repo_id", "relpath", "chosen_by", "place", ((F.col("score") >= 0) | (F.col("chosen_by") == "diversity")).alias("reviewed"))


def file_score(spark: SparkSession, d: str) -> DataFrame:
    """The plain score of Python files: churn, lines, four if no test file stands for the file, three a finding, less what
    a recent scan and a clean result take off."""
    j = _inventory(spark, d)
    stems = j.where(S.is_test(F.col("relpath"))).select("repo_id", F.regexp_replace(S.stem(F.col("relpath")), r"_test$|\.test$|\.spec$", "").alias("stem"))
    tested = stems.select("repo_id", F.regexp_replace("stem", "^test_", "").alias("stem")).distinct().withColumn("tested", F.lit(True))
    j = j.where(S.extension(F.col("relpath")) == ".py").withColumn("stem", S.stem(F.col("relpath"))).join(tested, ["repo_id", "stem"], "left")
    age = crawl.days(_at(), F.col("reviewed_at"))
    score = (
        F.least("churn", F.lit(20)) * 1.0 + F.least(F.col("lines") / 100, F.lit(10.0)) + F.when(F.col("tested"), 0.0).otherwise(4.0) + 3.0 * F.col("findings")
        - F.when(age < 1, 12.0).when(age < 3, 6.0).when(age < 7, 3.0).otherwise(0.0) - F.when(F.col("clean"), 2.0).otherwise(0.0)
    )
    return j.select("repo_id", "relpath", "lines", "churn", "findings", F.round(score, 6).alias("score"))


def scan_targets(spark: SparkSession, d: str) -> DataFrame:
    """Per repository the eight paths of most findings, long paths a little ahead, those scanned within a day far behind."""
    j = _inventory(spark, d)
    score = 3.0 * F.col("findings") + F.length("relpath") / 100.0 - F.when(crawl.days(_at(), F.col("reviewed_at")) < 1, 10.0).otherwise(0.0)
    w = Window.partitionBy("repo_id").orderBy(F.desc("score"), "relpath")
    return j.select("repo_id", "relpath", F.round(score, 6).alias("score")).withColumn("place", F.row_number().over(w)).where("place <= 8")


QUERIES = {f.__name__: f for f in (text_signals, signal_summary, crawl_inventory, crawl_scores, crawl_reasons, crawl_frontier, diversity_topk, file_score, scan_targets)}

_PATTERN = [  # as SQL has them: (no, rule, severity, confidence, most, pattern)
    (k, *x) for k, x in enumerate(SIGNALS)
]
_BREAKS = "length({0}) - length(replace({0}, chr(10), ''))"
_HIT = " UNION ALL ".join(
    f"SELECT file_id, {no} AS no, k AS hit, '{rule}' AS rule, '{sev}' AS severity, {conf}::double AS confidence, "
    f"({_BREAKS.format('(array_to_string(w[1:k - 1], chr(0)) || l[k])')} + 1)::int AS line FROM (SELECT file_id, regexp_extract_all(text, $$(?s)(.*?)(?:{p})$$, 0) AS w, regexp_extract_all(text, $$(?s)(.*?)(?:{p})$$, 1) AS l FROM texts WHERE regexp_matches(text, $${p}$$)), range(1, {most + 1}) r(k) WHERE k <= len(l)"
    for no, rule, sev, conf, most, p in _PATTERN
)
_SIG = (
    f"WITH @TEXTS, hits AS ({_HIT}), ranked AS (SELECT *, row_number() OVER (PARTITION BY file_id, rule ORDER BY no, hit) AS rn FROM hits), sig AS (SELECT file_id, no, hit, rule, severity, confidence, line FROM ranked WHERE rule <> 'risky_api' OR rn <= 3 "
    "UNION ALL SELECT file_id, 11, 1, 'large_file', 'medium', 0.58, 0 FROM texts WHERE @COUNT >= 250 "
    "UNION ALL SELECT file_id, 12, 1, 'deferred_work', 'low', 0.5, 0 FROM texts WHERE (length(text) - length(replace(text, 'TODO', ''))) // 4 + (length(text) - length(replace(text, 'FIXME', ''))) // 5 >= 3)"
)
_SUM = ", w AS (SELECT *, CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 4 WHEN 'high' THEN 8 ELSE 12 END AS rank FROM sig), summary AS (SELECT file_id, count(*) AS signals, arg_max(severity, rank) AS max_severity, sum(rank)::bigint AS risk, max(confidence) AS confidence FROM w GROUP BY 1)"
_TOUCH = "(SELECT repo_id, relpath, count(*) AS n FROM (SELECT repo_id, unnest(paths) AS relpath FROM changesets WHERE created_at BETWEEN @ASOF - INTERVAL {0} DAY AND @ASOF) WHERE relpath IS NOT NULL GROUP BY 1, 2)"
_INV = (
    _SIG + _SUM + ", new AS (SELECT * FROM (SELECT *, array_to_string(lines, chr(10)) AS text, row_number() OVER (PARTITION BY repo_id, relpath ORDER BY last_seen_at DESC, file_id DESC) AS rn FROM parse_results WHERE relpath IS NOT NULL) WHERE rn = 1), "
    "a AS (SELECT repo_id, relpath, @PARENT AS folder, file_id, last_seen_at AS crawled_at, CASE WHEN lines IS NULL THEN 0 ELSE @COUNT END AS n, content_hash, CASE WHEN content_hash IS NOT NULL THEN last_seen_at END AS reviewed_at, "
    "coalesce(sha256(source_bytes) <> content_hash, true) AS changed FROM new), "
    "found AS (SELECT repo_id, evidence.file AS relpath, count(*) AS findings, count(*) FILTER (coalesce(status, 'new') NOT IN ('fixed', 'permanently_failed')) AS unresolved, "
    r"max(CASE lower(regexp_replace(severity, '^\s+|\s+$', '', 'g')) WHEN 'low' THEN 1 WHEN 'medium' THEN 4 WHEN 'high' THEN 8 WHEN 'critical' THEN 12 END) AS severity_rank FROM findings WHERE evidence.file IS NOT NULL GROUP BY 1, 2), "
    f"c30 AS {_TOUCH.format(30)}, c14 AS {_TOUCH.format(14)}, "
    "b AS (SELECT a.*, coalesce(findings, 0) AS findings, coalesce(unresolved, 0) AS unresolved, coalesce(severity_rank, 1) AS severity_rank, coalesce(c30.n, 0) AS churn, coalesce(c14.n, 0) AS selections, coalesce(signals, 0) AS signals, coalesce(risk, 0) AS risk, coalesce(confidence, 0.0) AS confidence FROM a "
    "LEFT JOIN found f ON f.repo_id = a.repo_id AND f.relpath = a.relpath LEFT JOIN c30 ON c30.repo_id = a.repo_id AND c30.relpath = a.relpath LEFT JOIN c14 ON c14.repo_id = a.repo_id AND c14.relpath = a.relpath LEFT JOIN summary s ON s.file_id = a.file_id), "
    "r AS (SELECT repo_id, selections AS x, row_number() OVER (PARTITION BY repo_id ORDER BY selections) AS i FROM b), g AS (SELECT repo_id, CASE WHEN sum(x) = 0 THEN 0.0::double ELSE greatest(0.0::double, round(2.0::double * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1)::double / count(*), 6)) END AS gini FROM r GROUP BY 1), "
    "act AS (SELECT DISTINCT repo_id, folder FROM b WHERE changed OR crawled_at >= @ASOF - INTERVAL 7 DAY), "
    "inv AS (SELECT b.repo_id, relpath, n::int AS lines, reviewed_at, changed, findings, unresolved, severity_rank, churn, selections, g.gini, signals, risk, confidence, (act.folder IS NOT NULL AND NOT changed) AS neighbor_changed, (content_hash IS NOT NULL AND findings = 0) AS clean "
    "FROM b LEFT JOIN act ON act.repo_id = b.repo_id AND act.folder = b.folder LEFT JOIN g ON g.repo_id = b.repo_id)"
)
_AGE = "((epoch_us(@ASOF) - epoch_us(reviewed_at)) / 86400e6)"
_TTL = "(CASE WHEN @TEST THEN 14 WHEN regexp_matches(relpath, '^(src|lib|app|pkg)/') THEN 7 ELSE 21 END)"
_RULES = [
    ("never_reviewed", "reviewed_at IS NULL", "30.0"), ("content_changed", "changed", "20.0"), ("stale_review_ttl", f"{_AGE} >= {_TTL}", "18.0"),
    ("eligibility_window_open", f"{_AGE} >= CASE WHEN findings > 0 THEN 1 ELSE {_TTL} END", "5.0"), ("neighbor_changed", "neighbor_changed", "6.0"), ("unresolved_findings", "unresolved > 0", "8 * unresolved"),
    ("historical_findings", "findings > 0", "4 * findings"), ("severity_history", "true", "severity_rank"), ("recent_churn", "churn > 0", "least(churn, 20)"), ("file_size", "lines > 0", "least(lines / 100.0::double, 10.0::double)"),
    ("large_file_penalty", "lines > 350", "-least((lines - 350) / 120.0::double, 18.0::double)"), ("gini_repeat_penalty", "gini >= 0.35 AND selections > 1", "-least((selections - 1) * 4 * gini, 18.0::double)"),
    ("production_code", "regexp_matches(relpath, '^(src|lib|app|pkg)/')", "2.0"), ("recent_review", f"{_AGE} < 7", f"CASE WHEN {_AGE} < 1 THEN -12.0 WHEN {_AGE} < 3 THEN -6.0 ELSE -3.0 END"),
    ("stale_review", f"{_AGE} >= 7", f"least({_AGE} / 7, 6.0::double)"), ("previously_clean", "clean AND NOT changed", "-2.0"), ("test_file", "@TEST", "1.0"), ("detector_signals", "signals > 0", "18 * signals"),
    ("detector_risk", "risk > 0", "least(risk, 8)"), ("detector_confidence", "confidence > 0", "10 * confidence"),
]
_SCORED = (
    _INV + ", scored AS (SELECT *, round(" + " + ".join(f"CASE WHEN coalesce({c}, false) THEN ({x})::double ELSE 0.0::double END" for _, c, x in _RULES) + ", 3) AS score, "
    + " + ".join(f"CASE WHEN coalesce({c}, false) THEN 1 ELSE 0 END" for _, c, _ in _RULES) + " AS fired FROM inv)"
)
_FRONT = "ORDER BY score DESC, findings DESC, churn DESC, relpath"


def _sql(s: str) -> str:
    from quern.plans import inventory

    return inventory._sql(s.replace("@ASOF", f"TIMESTAMPTZ '{AS_OF} 00:00:00+00'"))


SQL = {
    k: _sql(v)
    for k, v in {
        "text_signals": _SIG + " SELECT * FROM sig",
        "signal_summary": _SIG + _SUM + " SELECT * FROM summary",
        "crawl_inventory": _INV + " SELECT * EXCLUDE (reviewed_at), coalesce(epoch_us(reviewed_at), 0) AS reviewed_us FROM inv",
        "crawl_scores": _SCORED + " SELECT repo_id, relpath, score, fired FROM scored",
        "crawl_reasons": _INV + " " + " UNION ALL ".join(f"SELECT repo_id, relpath, '{n}' AS rule, round(({x})::double, 3) AS impact FROM inv WHERE {c}" for n, c, x in _RULES),
        "crawl_frontier": _SCORED + f", q AS (SELECT *, row_number() OVER (PARTITION BY repo_id {_FRONT}) AS place FROM scored) SELECT repo_id, relpath, score, place FROM q WHERE place <= 20",
        "diversity_topk": _SCORED + f", q AS (SELECT *, row_number() OVER (PARTITION BY repo_id {_FRONT}) AS r FROM scored), sel AS (SELECT repo_id, relpath, max(created_at) AS t FROM (SELECT repo_id, unnest(paths) AS relpath, created_at FROM changesets WHERE created_at <= @ASOF) WHERE relpath IS NOT NULL GROUP BY 1, 2), "
        "o AS (SELECT q.*, row_number() OVER (PARTITION BY q.repo_id ORDER BY t IS NOT NULL, date_trunc('second', t), score DESC, q.relpath) AS p FROM q LEFT JOIN sel ON sel.repo_id = q.repo_id AND sel.relpath = q.relpath WHERE r > 6) "
        "SELECT repo_id, relpath, 'priority' AS chosen_by, r AS place, score >= 0 AS reviewed FROM q WHERE r <= 6 UNION ALL SELECT repo_id, relpath, 'diversity', p, true FROM o WHERE p <= 2",
        "file_score": _INV + r", st AS (SELECT DISTINCT repo_id, regexp_replace(regexp_replace(regexp_replace(@BASE, '(.)\.[^.]*$', '\1'), '_test$|\.test$|\.spec$', ''), '^test_', '') AS stem FROM inv WHERE @TEST) "
        r"SELECT repo_id, relpath, lines, churn, findings, round(least(churn, 20) + least(lines / 100.0::double, 10.0::double) + CASE WHEN EXISTS (SELECT 1 FROM st WHERE st.repo_id = inv.repo_id AND st.stem = regexp_replace(@BASE, '(.)\.[^.]*$', '\1')) THEN 0 ELSE 4 END + 3 * findings "
        f"- CASE WHEN {_AGE} < 1 THEN 12 WHEN {_AGE} < 3 THEN 6 WHEN {_AGE} < 7 THEN 3 ELSE 0 END - CASE WHEN clean THEN 2 ELSE 0 END, 6)::double AS score FROM inv WHERE @EXT = '.py'",
        "scan_targets": _INV + f", t AS (SELECT repo_id, relpath, 3.0::double * findings + length(relpath) / 100.0::double - CASE WHEN {_AGE} < 1 THEN 10.0::double ELSE 0.0::double END AS s FROM inv), q AS (SELECT repo_id, relpath, round(s, 6) AS score, row_number() OVER (PARTITION BY repo_id ORDER BY s DESC, relpath) AS place FROM t) SELECT * FROM q WHERE place <= 8",
    }.items()
}
