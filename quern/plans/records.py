"""Rows as the state files and reports have them: findings with defaults, issues, contexts, gates, orders, modes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import scalars as S
from quern.plans import crawl, dedup, findings, graph, inventory
from quern.sources.state import policies
from quern.sources.tables import table

AS_OF = "2025-11-01"
#: Fixed: states in which an earlier finding makes an alike one superfluous.
SETTLED = ("fixed", "issue-opened", "failed", "permanently_failed")


def _f(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "findings").where("finding_key is not null")


def finding_rows(spark: SparkSession, d: str) -> DataFrame:
    """Findings with the defaults of a new one where a field is missing, and how many fields are at their default."""
    nothing = ("processed_at", "pr_number", "pr_url", "pr_state", "merge_outcome", "branch_name", "issue_number", "issue_url", "suppressed_until", "suppression_reason", "fail_reason", "fixability", "confidence_score", "rollout_mode", "pr_quality_score")
    empty = F.struct(F.lit(0).alias("tests_passed"), F.lit(0).alias("tests_failed"))
    n = F.lit(0)
    for c in nothing:
        n = n + F.col(c).isNull().cast("int")
    v = F.coalesce("verification", empty)
    return _f(spark, d).select(
        "finding_key", F.coalesce("severity", F.lit("low")).alias("severity"), F.coalesce("category", F.lit("")).alias("category"), F.coalesce("status", F.lit("new")).alias("status"), F.coalesce("attempt_count", F.lit(0)).alias("attempt_count"),
        F.coalesce(v["tests_passed"], F.lit(0)).alias("tests_passed"), F.coalesce(v["tests_failed"], F.lit(0)).alias("tests_failed"), n.alias("defaults"),
    )


def crawl_state_rows(spark: SparkSession, d: str) -> DataFrame:
    """Crawl state with the older column filled into the newer ones where these are missing or empty; per file."""
    p = table(spark, d, "parse_results").where("relpath is not null")
    legacy, seen = F.coalesce(F.unix_micros("last_seen_at").cast("string"), F.lit("")), F.coalesce(F.unix_micros("first_seen_at").cast("string"), F.lit(""))
    back = F.coalesce(F.nullif(seen, F.lit("")), F.nullif(legacy, F.lit("")))
    return p.select("file_id", "relpath", back.alias("last_reviewed"), F.coalesce(F.nullif(legacy, F.lit("")), F.nullif(seen, F.lit(""))).alias("last_crawled"), F.coalesce("content_hash", F.lit("")).alias("last_hash"))


def review_issues(spark: SparkSession, d: str) -> DataFrame:
    """Review findings as issues give them: id from file, line and the first 50 characters, severity medium unless known."""
    e = F.col("evidence")
    sev = F.coalesce("severity", F.lit("low"))
    line = F.coalesce(e["line"], F.lit(0)).cast("string")
    f = _f(spark, d).where((F.coalesce("description", F.lit("")) != "") & (F.coalesce(e["file"], F.lit("")) != ""))
    raw = F.concat(F.lit("llm-review-"), e["file"], F.lit("-"), line, F.lit("-"), F.substring("description", 1, 50))
    return f.select("finding_key", F.concat(F.lit("llm-review-"), S.short_hash(raw)).alias("issue_id"), F.when(sev.isin(*S.SEVERITIES), sev).otherwise("medium").alias("severity"),
        F.concat(F.lit("["), F.coalesce(e["category_detail"], F.lit("")), F.lit("] "), "description").alias("description"))


def detector_context(spark: SparkSession, d: str) -> DataFrame:
    """Findings with the signals of the newest delivery of their file: how many, the risk, and the first ten."""
    s = crawl.text_signals(spark, d)
    listed = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("no", "hit", F.concat_ws(":", "rule", "severity", F.col("line").cast("string")).alias("t")))), 1, 10), lambda x: x["t"])
    per = s.groupBy("file_id").agg(F.array_join(listed, ",").alias("signals"))  # a file has a few dozen signals at most
    per = per.join(crawl.signal_summary(spark, d).select("file_id", F.col("signals").alias("n"), "risk"), "file_id")
    newest = table(spark, d, "parse_results").where("relpath is not null").groupBy("repo_id", F.col("relpath").alias("file")).agg(F.max_by("file_id", F.struct("last_seen_at", "file_id")).alias("file_id"))
    f = _f(spark, d).select("finding_key", "repo_id", F.col("evidence.file").alias("file"))
    return f.join(newest, ["repo_id", "file"]).join(per, "file_id").select("finding_key", "n", "risk", "signals")


def confident_findings(spark: SparkSession, d: str) -> DataFrame:
    return _f(spark, d).where("confidence_score >= 0.55").select("finding_key", "confidence_score")


def policy_gates(spark: SparkSession, d: str) -> DataFrame:
    """Findings beside the policy of their category (that of others where it has none), and the first gate that stops them."""
    base = spark.createDataFrame([("dead-code", True, "fix", 0.7, 20), ("llm-review", True, "fix", 0.7, 20), ("syntax-error", True, "fix", 0.9, 20), ("*", True, "issue-only", 0.7, 20)], "category string, enabled boolean, mode string, min_confidence double, max_findings int")
    over = spark.createDataFrame([("dead-code", "false", None, None, None), ("llm-review", "perhaps", "confirm", "0.5", "-3"), ("gone", "true", "fix", "0.1", "5"), ("syntax-error", None, "nowhere", "1.5", "7")], "category string, enabled string, mode string, min_confidence string, max_findings string")
    p = policies(base, over)
    f = _f(spark, d).select("finding_key", F.coalesce(S.tidy(F.col("category")), F.lit("")).alias("c"), F.coalesce("confidence_score", F.lit(0.0)).alias("conf"))
    own, other = p.where("category <> '*'"), p.where("category = '*'").select(F.struct("enabled", "mode", "min_confidence").alias("o"))
    j = f.join(F.broadcast(own), f.c == own.category, "left").crossJoin(F.broadcast(other))  # four literal rows
    pick = lambda k: F.when(F.col("category").isNull(), F.col(f"o.{k}")).otherwise(F.col(k))
    gate = F.when(~pick("enabled"), "disabled").when(pick("mode") == "issue-only", "issue-only").when(F.col("conf") < pick("min_confidence"), "confidence").otherwise("open")
    return j.select("finding_key", F.coalesce("category", F.lit("*")).alias("policy"), gate.alias("gate"))


def recent_prs(spark: SparkSession, d: str) -> DataFrame:
    """Per repository its twenty newest pull requests by the time of their newest finding."""
    p = _f(spark, d).where("pr_number is not null and processed_at is not null").groupBy("repo_id", "pr_number").agg(F.unix_micros(F.max("processed_at")).alias("newest"), F.count(F.lit(1)).alias("findings"))
    rn = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("newest"), F.desc("pr_number")))
    return p.withColumn("place", rn).where("place <= 20")


def schedule_order(spark: SparkSession, d: str) -> DataFrame:
    """Per repository the fifty findings of the highest priority, equal ones in the order of arrival."""
    p = graph.priority_score(spark, d).join(_f(spark, d).select("finding_key", "repo_id", "batch_no"), "finding_key")
    rn = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("priority"), F.asc_nulls_last("batch_no"), "finding_key"))
    return p.withColumn("place", rn).where("place <= 50").select("repo_id", "place", "finding_key", "priority")


def ordered_groups(spark: SparkSession, d: str) -> DataFrame:
    """Of each repository the first thirty groups of similar findings by their key."""
    g = findings.group_similar(spark, d)
    return g.withColumn("place", F.row_number().over(Window.partitionBy("repo_id").orderBy("grp"))).where("place <= 30").select("repo_id", "place", "grp", "findings")


def appended_findings(spark: SparkSession, d: str) -> DataFrame:
    """What the list of findings has after the last batch: what was there, what came, and what was skipped, none lost."""
    f = _f(spark, d).where("batch_no is not null")
    last = f.agg(F.max("batch_no").alias("last"))
    f = f.crossJoin(F.broadcast(last))  # one row
    dup = legacy_dedup(spark, d).select("finding_key", F.lit("skipped").alias("s"))
    old, new = f.where("batch_no < last").select("finding_key", F.lit("kept").alias("origin")), f.where("batch_no = last").select("finding_key")
    return old.unionByName(new.join(dup, "finding_key", "left").select("finding_key", F.coalesce("s", F.lit("added")).alias("origin")))


def legacy_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The earlier row of its repository (lower batch) that makes a finding superfluous, and why: the first with its id,
    whatever its state, or else the first settled one with its category, file and description hash."""
    text = lambda c: F.coalesce(c, F.lit(""))
    f = _f(spark, d).where("batch_no is not null").select(
        "finding_key", "repo_id", "batch_no", "finding_id", text(F.col("category")).alias("category"), text(F.col("evidence.file")).alias("file"), S.short_hash(text(F.col("description"))).alias("dh"), "status", "pr_number"
    )
    first = F.min(F.struct("batch_no", "finding_key", "status", "pr_number"))
    by_id = f.where("finding_id is not null").groupBy("repo_id", "finding_id").agg(first.alias("a"))
    by_text = f.where(F.col("status").isin(*SETTLED)).groupBy("repo_id", "category", "file", "dh").agg(first.alias("b"))
    j = f.select("finding_key", "repo_id", "batch_no", "finding_id", "category", "file", "dh").join(by_id, ["repo_id", "finding_id"], "left").join(by_text, ["repo_id", "category", "file", "dh"], "left")
    one, two = F.col("a.batch_no") < F.col("batch_no"), F.col("b.batch_no") < F.col("batch_no")
    state = F.when(F.col("a.status") == "permanently_failed", "permanently_failed").when((F.col("a.status") == "fixed") & F.col("a.pr_number").isNotNull(), "fixed-with-pr").otherwise("same-id")
    return j.select("finding_key", F.coalesce(F.when(one, F.col("a.finding_key")), F.when(two, F.col("b.finding_key"))).alias("duplicate_of"), F.when(one, state).when(two, F.lit("same-text")).alias("reason")).where("duplicate_of is not null")


def drift_batches(spark: SparkSession, d: str) -> DataFrame:
    """Of the last five batches of a repository those with more than two attempts on a finding and over three findings."""
    b = _f(spark, d).where("batch_no is not null").groupBy("repo_id", "batch_no").agg(F.max(F.coalesce("attempt_count", F.lit(0))).alias("repairs"), F.count(F.lit(1)).alias("findings"))
    rn = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("batch_no")))
    return b.withColumn("rn", rn).where("rn <= 5 and repairs > 2 and findings > 3").select("repo_id", "batch_no", "repairs", "findings")


def selection_rings(spark: SparkSession, d: str) -> DataFrame:
    """Per path the seconds of its last twelve changes, the oldest of them first."""
    c = table(spark, d, "changesets").where("created_at is not null").select("repo_id", F.explode("paths").alias("path"), F.unix_seconds("created_at").alias("t"), "changeset_id").where("path is not null")
    rn = F.row_number().over(Window.partitionBy("repo_id", "path").orderBy(F.desc("t"), F.desc("changeset_id")))
    last = c.withColumn("rn", rn).where("rn <= 12")
    return last.groupBy("repo_id", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda x: x.cast("string")), ",").alias("ring"))


def embedding_matches(spark: SparkSession, d: str) -> DataFrame:
    """Vectors whose nearest centroid is at least 0.85 like them."""
    return dedup.embedding_nearest(spark, d).where("similarity >= 0.85")


def imports_top3(spark: SparkSession, d: str) -> DataFrame:
    """Of each symbol the first three callees by name."""
    e = graph.graph_edges(spark, d)
    return e.withColumn("rn", F.row_number().over(Window.partitionBy("caller").orderBy("callee"))).where("rn <= 3")


def invalid_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols that a shard must not have, and the first reason: no id, an id of another path or name, an unknown kind, or
    lines out of order."""
    s = table(spark, d, "symbols").distinct()
    why = (
        F.when(F.col("symbol_id").isNull(), "no id").when(~F.col("symbol_id").eqNullSafe(F.concat_ws("::", "path", "name")), "other id").when(~F.coalesce(F.col("kind").isin("function", "class", "method"), F.lit(False)), "unknown kind")
        .when(F.coalesce("start_line", F.lit(0)) < 1, "no start").when(F.col("end_line").isNull() | (F.col("end_line") < F.col("start_line")), "no end")
    )
    return s.select("symbol_id", "repo_id", "path", "name", F.coalesce("start_line", F.lit(0)).alias("start_line"), why.alias("reason")).where("reason is not null")


def index_modes(spark: SparkSession, d: str) -> DataFrame:
    """Per repository how its index is brought up to date: cold (there was none), full hit (nothing has changed), shard
    reuse (every content at hand has been stored before, for whatever path), or incremental."""
    before, now = inventory.latest(spark, d)
    state = inventory.snapshot_diff(spark, d).groupBy("repo_id").agg(F.count_if(F.col("state") != "same").alias("changed"))
    old = before.groupBy("repo_id").agg(F.count(F.lit(1)).alias("before"))
    stored = before.select("repo_id", "hash").distinct()
    lacking = now.join(stored, ["repo_id", "hash"], "left_anti").groupBy("repo_id").agg(F.count(F.lit(1)).alias("missing"))
    have = now.groupBy("repo_id").agg(F.count(F.lit(1)).alias("files"))
    j = state.join(old, "repo_id", "left").join(lacking, "repo_id", "left").join(have, "repo_id", "left").fillna(0, ["before", "missing", "files"])
    mode = F.when(F.col("before") == 0, "cold").when(F.col("changed") == 0, "full-hit").when((F.col("missing") == 0) & (F.col("files") > 0), "shard-reuse").otherwise("incremental")
    return j.select("repo_id", mode.alias("mode"), "changed", "missing", "files")


def repo_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Per repository of the registry: findings done, failed and skipped, zero where it has none."""
    s = F.coalesce("status", F.lit("new"))
    g = _f(spark, d).groupBy("repo_id").agg(F.count_if(s.isin("fixed", "issue-opened")).alias("ok"), F.count_if(s.isin("failed", "permanently_failed")).alias("failed"), F.count_if(s.startswith("skipped") | s.startswith("suppressed")).alias("skipped"))
    return table(spark, d, "repos").where("path is not null").select("repo_id").distinct().join(g, "repo_id", "left").fillna(0)


def findings_in_feed(spark: SparkSession, d: str) -> DataFrame:
    """Open findings whose id or detail some pull request or issue already carries in its branch or reason."""
    f = _f(spark, d)
    feed = f.where("pr_number is not null or issue_number is not null").where("finding_id is not null").select("repo_id", S.tidy(F.col("finding_id")).alias("term")).distinct()
    new = f.where("pr_number is null and issue_number is null").select("finding_key", "repo_id", S.tidy(F.col("finding_id")).alias("term"))
    return new.join(feed, ["repo_id", "term"], "left_semi").select("finding_key", "repo_id")


def scan_events(spark: SparkSession, d: str) -> DataFrame:
    """The event with which the scan of each changeset starts."""
    c = table(spark, d, "changesets").where("changeset_id is not null and created_at is not null")
    return c.select(F.lit("ScanStarted").alias("event"), S.scan_id(F.col("created_at"), F.sha2(F.col("changeset_id").cast("string"), 256)).alias("scan_id"), "repo_id", F.coalesce("is_fresh_instance", F.lit(False)).alias("sweep"), F.greatest(F.coalesce(F.size("paths"), F.lit(0)), F.lit(0)).alias("paths"))


def attempt_summary(spark: SparkSession, d: str) -> DataFrame:
    """Over all findings that were attempted: how many, how many came through, the rate, and all attempts."""
    f = _f(spark, d).where("attempt_count > 0")
    return f.agg(F.count(F.lit(1)).alias("tasks"), F.count_if(F.coalesce("status", F.lit("")) == "fixed").alias("resolved"), F.round(F.coalesce(F.avg((F.coalesce("status", F.lit("")) == "fixed").cast("double")), F.lit(0.0)), 6).alias("pass_rate"), F.coalesce(F.sum("attempt_count"), F.lit(0)).alias("attempts"))


def q_states(spark: SparkSession, d: str) -> DataFrame:
    """Findings by category, extension, centrality tier of their file and severity, joined to one key."""
    tiers = graph.centrality_tier(spark, d).select("symbol_id", "tier", "degree")
    host = table(spark, d, "symbols").select("symbol_id", "repo_id", "path").distinct()
    per = host.join(tiers, "symbol_id").groupBy("repo_id", F.col("path").alias("file")).agg(F.max_by("tier", F.struct("degree", "symbol_id")).alias("tier"))
    f = _f(spark, d).select("finding_key", "repo_id", F.coalesce(S.tidy(F.col("category")), F.lit("")).alias("c"), F.col("evidence.file").alias("file"), F.coalesce(S.tidy(F.col("severity")), F.lit("low")).alias("s"))
    j = f.join(per, ["repo_id", "file"], "left")
    return j.groupBy(F.concat_ws("|", "c", S.extension(F.coalesce("file", F.lit(""))), F.coalesce("tier", F.lit("low")), "s").alias("state")).agg(F.count(F.lit(1)).alias("findings"))


def unreferenced_functions(spark: SparkSession, d: str) -> DataFrame:
    """Functions whose name stands in the text of their repository no more often than files define it.

    Occurrences are textual, within longer names too. A name consists of word characters, so that it occurs within words
    only: every distinct word of a repository, counted first, is cut at all places into parts of the lengths that names
    have, and parts and names are joined. Names of tests, commands, entry points and private ones are left out.
    """
    free = ~F.col("name").rlike("^(_|cmd_|test_)") & ~F.col("name").isin("build_parser", "cli_main", "main", "setup", "teardown")
    s = table(spark, d, "symbols").where("kind = 'function' and name is not null").where(F.col("name").rlike("^[A-Za-z0-9_]+$") & free)
    names = s.groupBy("repo_id", "name").agg(F.countDistinct("path").alias("files"))
    lengths = names.agg(F.collect_set(F.length("name")).alias("lengths"))  # at most as many as a name has characters
    text = table(spark, d, "parse_results").where("lines is not null and relpath is not null").select("repo_id", F.explode("lines").alias("line"))
    words = text.select("repo_id", F.explode(F.regexp_extract_all("line", F.lit("([A-Za-z0-9_]+)"))).alias("word")).groupBy("repo_id", "word").agg(F.count(F.lit(1)).alias("n"))
    cut = words.crossJoin(F.broadcast(lengths)).select("repo_id", "word", "n", F.explode("lengths").alias("k")).where(F.length("word") >= F.col("k"))
    parts = cut.select("repo_id", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - F.col("k") + 1), lambda i: F.substring(F.col("word"), i, F.col("k")))).alias("name"))
    seen = parts.join(names.select("repo_id", "name"), ["repo_id", "name"], "left_semi").groupBy("repo_id", "name").agg(F.sum("n").alias("occurrences"))
    return names.join(seen, ["repo_id", "name"], "left").fillna(0, ["occurrences"]).where("occurrences <= files").select("repo_id", "name", "files", "occurrences")


QUERIES = {
    f.__name__: f
    for f in (
        finding_rows, crawl_state_rows, review_issues, detector_context, confident_findings, policy_gates, recent_prs, schedule_order, ordered_groups, appended_findings, legacy_dedup, drift_batches, selection_rings, embedding_matches,
        imports_top3, invalid_symbols, index_modes, repo_outcomes, findings_in_feed, scan_events, attempt_summary, q_states, unreferenced_functions,
    )
}

_TIDY = r"lower(regexp_replace({0}, '^\s+|\s+$', '', 'g'))"
_NOTHING = ("processed_at", "pr_number", "pr_url", "pr_state", "merge_outcome", "branch_name", "issue_number", "issue_url", "suppressed_until", "suppression_reason", "fail_reason", "fixability", "confidence_score", "rollout_mode", "pr_quality_score")
_LEGACY = (
    "f AS (SELECT finding_key, repo_id, batch_no, finding_id, coalesce(category, '') AS category, coalesce(evidence.file, '') AS file, substr(sha256(coalesce(description, '')), 1, 16) AS dh, status, pr_number FROM findings WHERE finding_key IS NOT NULL AND batch_no IS NOT NULL), "
    "a AS (SELECT repo_id, finding_id, arg_min(struct_pack(b := batch_no, k := finding_key, s := status, p := pr_number), (batch_no, finding_key)) AS r FROM f WHERE finding_id IS NOT NULL GROUP BY 1, 2), "
    "b AS (SELECT repo_id, category, file, dh, arg_min(struct_pack(b := batch_no, k := finding_key), (batch_no, finding_key)) AS r FROM f WHERE status IN ('fixed', 'issue-opened', 'failed', 'permanently_failed') GROUP BY 1, 2, 3, 4), "
    "j AS (SELECT f.finding_key, CASE WHEN a.r.b < f.batch_no THEN a.r.k WHEN b.r.b < f.batch_no THEN b.r.k END AS duplicate_of, CASE WHEN a.r.b < f.batch_no THEN CASE WHEN a.r.s = 'permanently_failed' THEN 'permanently_failed' WHEN a.r.s = 'fixed' AND a.r.p IS NOT NULL THEN 'fixed-with-pr' ELSE 'same-id' END "
    "WHEN b.r.b < f.batch_no THEN 'same-text' END AS reason FROM f LEFT JOIN a ON a.repo_id = f.repo_id AND a.finding_id = f.finding_id LEFT JOIN b ON b.repo_id = f.repo_id AND b.category = f.category AND b.file = f.file AND b.dh = f.dh), "
    "dup AS (SELECT * FROM j WHERE duplicate_of IS NOT NULL)"
)


def _sql() -> dict[str, str]:
    ctx = crawl.SQL["text_signals"].removesuffix(" SELECT * FROM sig")
    summary = crawl.SQL["signal_summary"].removesuffix(" SELECT * FROM summary")
    assert summary.startswith(ctx)
    cat = _TIDY.format("category")
    return {
        "finding_rows": "SELECT finding_key, coalesce(severity, 'low') AS severity, coalesce(category, '') AS category, coalesce(status, 'new') AS status, coalesce(attempt_count, 0) AS attempt_count, coalesce(verification.tests_passed, 0) AS tests_passed, coalesce(verification.tests_failed, 0) AS tests_failed, "
        + " + ".join(f"({c} IS NULL)::int" for c in _NOTHING) + " AS defaults FROM findings WHERE finding_key IS NOT NULL",
        "crawl_state_rows": "SELECT file_id, relpath, coalesce(epoch_us(first_seen_at), epoch_us(last_seen_at))::varchar AS last_reviewed, coalesce(epoch_us(last_seen_at), epoch_us(first_seen_at))::varchar AS last_crawled, coalesce(content_hash, '') AS last_hash FROM parse_results WHERE relpath IS NOT NULL",
        "review_issues": "SELECT finding_key, 'llm-review-' || substr(sha256('llm-review-' || evidence.file || '-' || coalesce(evidence.line, 0) || '-' || substr(description, 1, 50)), 1, 16) AS issue_id, CASE WHEN coalesce(severity, 'low') IN ('low', 'medium', 'high', 'critical') THEN coalesce(severity, 'low') ELSE 'medium' END AS severity, "
        "'[' || coalesce(evidence.category_detail, '') || '] ' || description AS description FROM findings WHERE finding_key IS NOT NULL AND description <> '' AND evidence.file <> ''",
        "detector_context": summary + ", l AS (SELECT file_id, array_to_string(list(rule || ':' || severity || ':' || line::varchar ORDER BY no, hit)[1:10], ',') AS signals FROM sig GROUP BY 1), newest AS (SELECT repo_id, relpath, arg_max(file_id, (last_seen_at, file_id)) AS file_id FROM parse_results WHERE relpath IS NOT NULL GROUP BY 1, 2) "
        "SELECT finding_key, s.signals AS n, s.risk, l.signals FROM findings f JOIN newest n ON n.repo_id = f.repo_id AND n.relpath = f.evidence.file JOIN l USING (file_id) JOIN summary s USING (file_id) WHERE finding_key IS NOT NULL",
        "confident_findings": "SELECT finding_key, confidence_score FROM findings WHERE finding_key IS NOT NULL AND confidence_score >= 0.55",
        "policy_gates": f"WITH p(category, enabled, mode, least_conf) AS (VALUES ('dead-code', false, 'fix', 0.7::double), ('llm-review', true, 'confirm', 0.5::double), ('syntax-error', true, 'fix', 0.9::double)), f AS (SELECT finding_key, coalesce({cat}, '') AS c, coalesce(confidence_score, 0) AS conf FROM findings WHERE finding_key IS NOT NULL) "
        "SELECT finding_key, coalesce(category, '*') AS policy, CASE WHEN NOT coalesce(enabled, true) THEN 'disabled' WHEN coalesce(mode, 'issue-only') = 'issue-only' THEN 'issue-only' WHEN conf < least_conf THEN 'confidence' ELSE 'open' END AS gate FROM f LEFT JOIN p ON p.category = f.c",
        "recent_prs": "WITH p AS (SELECT repo_id, pr_number, epoch_us(max(processed_at)) AS newest, count(*) AS findings FROM findings WHERE finding_key IS NOT NULL AND pr_number IS NOT NULL AND processed_at IS NOT NULL GROUP BY 1, 2), q AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY newest DESC, pr_number DESC) AS place FROM p) SELECT * FROM q WHERE place <= 20",
        "schedule_order": f"WITH pr AS ({graph.SQL['priority_score']}), q AS (SELECT f.repo_id, row_number() OVER (PARTITION BY f.repo_id ORDER BY priority DESC, batch_no NULLS LAST, finding_key) AS place, finding_key, priority FROM pr JOIN findings f USING (finding_key)) SELECT * FROM q WHERE place <= 50",
        "ordered_groups": f"WITH g AS ({findings.SQL['group_similar']}), q AS (SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY grp) AS place, grp, findings FROM g) SELECT * FROM q WHERE place <= 30",
        "appended_findings": f"WITH {_LEGACY} SELECT finding_key, CASE WHEN batch_no < (SELECT max(batch_no) FROM f) THEN 'kept' WHEN finding_key IN (SELECT finding_key FROM dup) THEN 'skipped' ELSE 'added' END AS origin FROM f",
        "legacy_dedup": f"WITH {_LEGACY} SELECT * FROM dup",
        "drift_batches": "WITH b AS (SELECT repo_id, batch_no, max(coalesce(attempt_count, 0)) AS repairs, count(*) AS findings, row_number() OVER (PARTITION BY repo_id ORDER BY batch_no DESC) AS rn FROM findings WHERE finding_key IS NOT NULL AND batch_no IS NOT NULL GROUP BY 1, 2) SELECT repo_id, batch_no, repairs, findings FROM b WHERE rn <= 5 AND repairs > 2 AND findings > 3",
        "selection_rings": "WITH c AS (SELECT repo_id, path, epoch_us(created_at) // 1000000 AS t, row_number() OVER (PARTITION BY repo_id, path ORDER BY epoch_us(created_at) // 1000000 DESC, changeset_id DESC) AS rn FROM (SELECT repo_id, changeset_id, created_at, unnest(paths) AS path FROM changesets WHERE created_at IS NOT NULL) WHERE path IS NOT NULL) "
        "SELECT repo_id, path, string_agg(t::varchar, ',' ORDER BY t) AS ring FROM c WHERE rn <= 12 GROUP BY 1, 2",
        "embedding_matches": f"SELECT * FROM ({dedup.SQL['embedding_nearest']}) WHERE similarity >= 0.85",
        "imports_top3": f"WITH e AS ({graph.SQL['graph_edges']}), q AS (SELECT *, row_number() OVER (PARTITION BY caller ORDER BY callee) AS rn FROM e) SELECT * FROM q WHERE rn <= 3",
        "invalid_symbols": "SELECT * FROM (SELECT symbol_id, repo_id, path, name, coalesce(start_line, 0) AS start_line, CASE WHEN symbol_id IS NULL THEN 'no id' WHEN symbol_id IS DISTINCT FROM concat_ws('::', path, name) THEN 'other id' WHEN kind IS NULL OR kind NOT IN ('function', 'class', 'method') THEN 'unknown kind' WHEN coalesce(start_line, 0) < 1 THEN 'no start' WHEN end_line IS NULL OR end_line < start_line THEN 'no end' END AS reason "
        "FROM (SELECT DISTINCT * FROM symbols)) WHERE reason IS NOT NULL",
        "index_modes": inventory.SQL["snapshot_diff"].removesuffix(" SELECT repo_id, relpath, state FROM d") + ", s AS (SELECT repo_id, count(*) FILTER (state <> 'same') AS changed FROM d GROUP BY 1), m AS (SELECT repo_id, count(*) AS files, count(*) FILTER (NOT EXISTS (SELECT 1 FROM a WHERE a.repo_id = b.repo_id AND a.hash = b.hash)) AS missing FROM b GROUP BY 1) "
        "SELECT s.repo_id, CASE WHEN NOT EXISTS (SELECT 1 FROM a WHERE a.repo_id = s.repo_id) THEN 'cold' WHEN changed = 0 THEN 'full-hit' WHEN coalesce(missing, 0) = 0 AND coalesce(files, 0) > 0 THEN 'shard-reuse' ELSE 'incremental' END AS mode, changed, coalesce(missing, 0) AS missing, coalesce(files, 0) AS files FROM s LEFT JOIN m USING (repo_id)",
        "repo_outcomes": "SELECT r.repo_id, count(*) FILTER (status IN ('fixed', 'issue-opened')) AS ok, count(*) FILTER (status IN ('failed', 'permanently_failed')) AS failed, count(*) FILTER (starts_with(status, 'skipped') OR starts_with(status, 'suppressed')) AS skipped FROM (SELECT DISTINCT repo_id FROM repos WHERE path IS NOT NULL) r LEFT JOIN (SELECT * FROM findings WHERE finding_key IS NOT NULL) f ON f.repo_id = r.repo_id GROUP BY 1",
        "findings_in_feed": f"SELECT finding_key, repo_id FROM findings f WHERE finding_key IS NOT NULL AND pr_number IS NULL AND issue_number IS NULL AND EXISTS (SELECT 1 FROM findings g WHERE g.finding_key IS NOT NULL AND g.repo_id = f.repo_id AND (g.pr_number IS NOT NULL OR g.issue_number IS NOT NULL) AND {_TIDY.format('g.finding_id')} = {_TIDY.format('f.finding_id')})",
        "scan_events": "SELECT 'ScanStarted' AS event, strftime(created_at AT TIME ZONE 'UTC', '%Y%m%dT%H%M%SZ') || '-' || substr(sha256(changeset_id::varchar), 1, 8) AS scan_id, repo_id, coalesce(is_fresh_instance, false) AS sweep, coalesce(len(paths), 0) AS paths FROM changesets WHERE changeset_id IS NOT NULL AND created_at IS NOT NULL",
        "attempt_summary": "SELECT count(*) AS tasks, count(*) FILTER (status = 'fixed') AS resolved, round(coalesce(avg((coalesce(status, '') = 'fixed')::int), 0), 6)::double AS pass_rate, coalesce(sum(attempt_count), 0)::bigint AS attempts FROM findings WHERE finding_key IS NOT NULL AND attempt_count > 0",
        "q_states": f"WITH ct AS ({graph.SQL['centrality_tier']}), per AS (SELECT y.repo_id, y.path, arg_max(tier, (degree, y.symbol_id)) AS tier FROM (SELECT DISTINCT symbol_id, repo_id, path FROM symbols) y JOIN ct USING (symbol_id) GROUP BY 1, 2) "
        rf"SELECT coalesce({cat}, '') || '|' || lower(regexp_extract(coalesce(evidence.file, ''), '(\.[^./\\]+)$', 1)) || '|' || coalesce(tier, 'low') || '|' || coalesce({_TIDY.format('severity')}, 'low') AS state, count(*) AS findings FROM findings f LEFT JOIN per ON per.repo_id = f.repo_id AND per.path = f.evidence.file WHERE finding_key IS NOT NULL GROUP BY 1",
        "unreferenced_functions": "WITH n AS (SELECT repo_id, name, count(DISTINCT path) AS files FROM symbols WHERE kind = 'function' AND regexp_full_match(name, '[A-Za-z0-9_]+') AND NOT regexp_matches(name, '^(_|cmd_|test_)') AND name NOT IN ('build_parser', 'cli_main', 'main', 'setup', 'teardown') GROUP BY 1, 2), "
        "t AS (SELECT repo_id, string_agg(array_to_string(lines, chr(10)), chr(10)) AS x FROM parse_results WHERE lines IS NOT NULL AND relpath IS NOT NULL GROUP BY 1), o AS (SELECT n.repo_id, n.name, files, coalesce((length(x) - length(replace(x, name, ''))) // length(name), 0) AS occurrences FROM n LEFT JOIN t USING (repo_id)) "
        "SELECT * FROM o WHERE occurrences <= files",
    }


SQL = _sql()
