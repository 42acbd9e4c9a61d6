"""Queries on findings: fingerprints, packets, gates, grouping, pruning, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import scalars as S
from quern.operators import joins
from quern.sources.tables import table

AS_OF = "2025-11-01"


def _f(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "findings").where("finding_key is not null")


def findings_by_file(spark: SparkSession, d: str) -> DataFrame:
    sev = S.lookup(S.SEVERITIES, S.tidy(F.col("severity")))
    f = _f(spark, d).withColumn("file", F.col("evidence.file")).where("file is not null")
    return f.groupBy("repo_id", "file").agg(
        F.count(F.lit(1)).alias("findings"), F.count_if(~F.coalesce("status", F.lit("new")).isin("fixed", "permanently_failed")).alias("unresolved"), F.max(sev).alias("max_rank"), F.unix_micros(F.max("found_at")).alias("last_found")
    )


def finding_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Line-independent fingerprints: category, file, detail and snippet, white space collapsed."""
    e = F.col("evidence")
    return _f(spark, d).select("finding_key", S.fingerprint(S.tidy(F.col("category")), e["file"], e["category_detail"], S.squeeze(e["snippet"])).alias("fingerprint"))


def evidence_packet(spark: SparkSession, d: str) -> DataFrame:
    """A canonical JSON packet (sorted keys, no spaces) of each finding, and its sha256."""
    text = lambda c: F.coalesce(c, F.lit(""))
    packet = F.struct(
        text(S.tidy(F.col("category"))).alias("category"), text(F.col("evidence.file")).alias("file"), F.coalesce(F.col("evidence.line"), F.lit(0)).alias("line"), text(F.col("severity")).alias("severity"),
        text(F.col("evidence.snippet")).alias("snippet"),
    )
    p = _f(spark, d).select("finding_key", F.to_json(packet, {"ignoreNullFields": "false"}).alias("packet"))
    return p.withColumn("prefix_hash", F.sha2("packet", 256))


def rule_suppression(spark: SparkSession, d: str) -> DataFrame:
    """The first unexpired rule that a finding meets: its id, or else category and path prefix (NULL: any)."""
    rules = spark.createDataFrame(
        [(1, None, "dead-code", "lib/", "2026-01-01"), (2, None, "llm-review", "services/", "2025-01-01"), (3, None, "dependency-vuln", None, "2026-01-01"), (4, None, "llm-review", "core/", None)],
        "no int, rule_id string, rule_category string, prefix string, until string",
    )
    f = _f(spark, d).select("finding_key", S.tidy(F.col("finding_id")).alias("fid"), S.tidy(F.col("category")).alias("category"), F.coalesce("evidence.file", F.lit("")).alias("file"))
    live = rules.where("until is null or cast(until as timestamp) > timestamp '2025-11-01'")
    hit = f.join(F.broadcast(live), F.expr("rule_id = fid or (rule_id is null and rule_category = category and (prefix is null or startswith(file, prefix)))"))  # a literal table of rules
    return hit.groupBy("finding_key").agg(F.min("no").alias("rule"))


def duplicate_gate(spark: SparkSession, d: str) -> DataFrame:
    """Per packet hash the finding of the highest confidence is promoted, the others are duplicates."""
    p = evidence_packet(spark, d).join(_f(spark, d).select("finding_key", F.coalesce("confidence_score", F.lit(0.0)).alias("conf")), "finding_key")
    best = p.groupBy("prefix_hash").agg(F.max(F.struct("conf", (-F.col("finding_key")).alias("k"))).alias("b"))  # map-side, so that a hot hash is no hot task
    return p.join(best, "prefix_hash").select("finding_key", F.when(-F.col("finding_key") == F.col("b.k"), "promoted").otherwise("duplicate").alias("decision"))


def max_findings_cutoff(spark: SparkSession, d: str) -> DataFrame:
    """Per repository and category the first 20 distinct ids by arrival; repeats of kept ids are not counted."""
    f = _f(spark, d).where("finding_id is not null").select("repo_id", S.tidy(F.col("category")).alias("category"), S.tidy(F.col("finding_id")).alias("fid"), "batch_no", "finding_key")
    firsts = f.groupBy("repo_id", "category", "fid").agg(F.min(F.struct("batch_no", "finding_key")).alias("at"))
    rn = F.row_number().over(Window.partitionBy("repo_id", "category").orderBy("at"))
    return firsts.withColumn("rn", rn).where("rn <= 20").select("repo_id", "category", "fid", F.col("at.finding_key").alias("finding_key"), "rn")


def status_by_category(spark: SparkSession, d: str) -> DataFrame:
    """Counts by category and status, by each alone, and in all, in one pass over grouping sets."""
    f = _f(spark, d).select(F.coalesce(S.tidy(F.col("category")), F.lit("none")).alias("category"), F.coalesce("status", F.lit("none")).alias("status"), "confidence_score")
    g = f.cube("category", "status").agg(F.count(F.lit(1)).alias("findings"), F.round(F.avg("confidence_score"), 6).alias("confidence"))
    return g.select(F.coalesce("category", F.lit("*")).alias("category"), F.coalesce("status", F.lit("*")).alias("status"), "findings", "confidence")


def benchmark_by_category(spark: SparkSession, d: str) -> DataFrame:
    f = _f(spark, d).withColumn("category", F.coalesce(S.tidy(F.col("category")), F.lit("none")))
    on = lambda s: F.count_if(F.coalesce(F.col("merge_outcome"), F.lit("")) == s)
    g = f.groupBy("category").agg(F.count(F.lit(1)).alias("total"), F.count("pr_number").alias("prs"), on("merged").alias("merged"), on("closed").alias("closed"), on("reverted").alias("reverted"), F.round(F.avg("pr_quality_score"), 6).alias("quality"))
    return g.withColumn("merge_rate", F.when(F.col("prs") > 0, F.round(F.col("merged") / F.col("prs"), 6)))


def prune_findings(spark: SparkSession, d: str) -> DataFrame:
    """Per repository what is kept: fixed and opened ones, and the newest 50 others of the last 200 days."""
    age = F.lit(AS_OF).cast("timestamp") - F.expr("interval 200 days")
    f = _f(spark, d).select("finding_key", "repo_id", F.coalesce("status", F.lit("new")).isin("fixed", "issue-opened").alias("kept"), "found_at")
    rn = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc_nulls_last("found_at"), "finding_key"))
    others = f.where(~F.col("kept") & (F.col("found_at").isNull() | (F.col("found_at") >= age)))
    newest = others.withColumn("rn", rn).where("rn <= 50").drop("rn")  # limited before the shuffle
    return f.where("kept").unionByName(newest).select("finding_key", "repo_id", "kept")


def group_similar(spark: SparkSession, d: str) -> DataFrame:
    """Groups by file for reviews, by category and detail for the rest."""
    cat = F.coalesce(S.tidy(F.col("category")), F.lit("none"))
    key = F.when(cat == "llm-review", F.concat(F.lit("file:"), F.coalesce("evidence.file", F.lit("")))).otherwise(F.concat_ws("|", cat, F.coalesce("evidence.category_detail", F.lit(""))))
    return _f(spark, d).groupBy("repo_id", key.alias("grp")).agg(F.count(F.lit(1)).alias("findings"), F.min("finding_key").alias("first_key"), F.unix_micros(F.max("found_at")).alias("last_found"))


def latest_template(spark: SparkSession, d: str) -> DataFrame:
    """For each finding the newest earlier fixed finding of its repository, category and extension (as-of join)."""
    f = _f(spark, d).select("finding_key", "repo_id", S.tidy(F.col("category")).alias("category"), S.extension(F.coalesce("evidence.file", F.lit(""))).alias("ext"), "found_at", "status").where("category is not null and found_at is not null")
    return joins.as_of(f, f.where("status = 'fixed'"), ["repo_id", "category", "ext"], "found_at", "finding_key")


def band_match(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of findings of one file and category on lines at most five apart, the earlier key first (one row per key
    and partner's line, so that copies on one line are counted, not listed)."""
    f = _f(spark, d).select("finding_key", "repo_id", F.col("evidence.file").alias("file"), S.tidy(F.col("category")).alias("category"), F.col("evidence.line").alias("line")).where("file is not null and category is not null and line is not null")
    spots = f.groupBy("repo_id", "file", "category", "line").agg(F.count(F.lit(1)).alias("rows"), F.min("finding_key").alias("first_key"))
    return joins.band(spots, ["repo_id", "file", "category"], "line", 5)


def issue_validation(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose evidence is complete and well-typed once written to JSON and read back under a schema."""
    raw = _f(spark, d).select("finding_key", F.to_json("evidence").alias("js"), "severity", "confidence_score")
    got = raw.withColumn("e", F.from_json("js", "file string, line int, category_detail string"))
    ok = F.col("e.file").isNotNull() & (F.col("e.line") > 0) & S.tidy(F.col("severity")).isin(*S.SEVERITIES) & F.col("confidence_score").between(0, 1)
    return got.where(ok).select("finding_key", F.col("e.file").alias("file"), F.col("e.line").alias("line"), S.tidy(F.col("severity")).alias("severity"), F.col("confidence_score").alias("confidence"))


def sarif_results(spark: SparkSession, d: str) -> DataFrame:
    """One SARIF result per finding: rule, level, message, place."""
    level = F.when(S.tidy(F.col("severity")).isin("critical", "high"), "error").when(S.tidy(F.col("severity")) == "medium", "warning").otherwise("note")
    return _f(spark, d).select("finding_key", F.coalesce(S.tidy(F.col("category")), F.lit("none")).alias("rule_id"), level.alias("level"), S.truncated(F.coalesce("description", F.lit("")), 80).alias("message"),
        F.coalesce("evidence.file", F.lit("")).alias("uri"), F.greatest(F.coalesce("evidence.line", F.lit(1)), F.lit(1)).alias("start_line"))


def recurring_categories(spark: SparkSession, d: str) -> DataFrame:
    """Categories that a repository had in more than half of its last ten batches; at least three batches needed."""
    f = _f(spark, d).where("category is not null and batch_no is not null").select("repo_id", "batch_no", S.tidy(F.col("category")).alias("category")).distinct()
    b = f.select("repo_id", "batch_no").distinct()
    last = b.withColumn("rn", F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("batch_no")))).where("rn <= 10").select("repo_id", "batch_no")
    n = last.groupBy("repo_id").agg(F.count(F.lit(1)).alias("batches")).where("batches >= 3")
    g = f.join(last, ["repo_id", "batch_no"]).groupBy("repo_id", "category").agg(F.count(F.lit(1)).alias("had"))
    return g.join(n, "repo_id").where("had * 2 > batches").select("repo_id", "category", "had", "batches")


def pr_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """The outcome of each pull request and how many findings it closes."""
    f = _f(spark, d).where("pr_number is not null")
    return f.groupBy("repo_id", "pr_number").agg(F.count(F.lit(1)).alias("findings"), F.max(F.coalesce("merge_outcome", F.lit(""))).alias("outcome"), F.sum(F.coalesce("verification.tests_failed", F.lit(0))).alias("failed"))


QUERIES = {
    f.__name__: f
    for f in (
        findings_by_file, finding_fingerprint, evidence_packet, rule_suppression, duplicate_gate, max_findings_cutoff, status_by_category, benchmark_by_category, prune_findings, group_similar, latest_template,
        band_match, issue_validation, sarif_results, recurring_categories, pr_outcomes,
    )
}


def _tidy(c: str) -> str:
    return rf"lower(regexp_replace({c}, '^\s+|\s+$', '', 'g'))"


_F = "f AS (SELECT * FROM findings WHERE finding_key IS NOT NULL)"
_EXT = r"lower(regexp_extract(coalesce(evidence.file, ''), '(\.[^./\\]+)$', 1))"
_RANK = f"CASE {_tidy('severity')} WHEN 'low' THEN 1 WHEN 'medium' THEN 4 WHEN 'high' THEN 8 WHEN 'critical' THEN 12 END"
_PACKET = (
    f"WITH {_F}, p AS (SELECT finding_key, coalesce(confidence_score, 0) AS conf, '{{\"category\":' || to_json(coalesce({_tidy('category')}, '')) || ',\"file\":' || to_json(coalesce(evidence.file, '')) || ',\"line\":' || coalesce(evidence.line, 0) || "
    "',\"severity\":' || to_json(coalesce(severity, '')) || ',\"snippet\":' || to_json(coalesce(evidence.snippet, '')) || '}' AS packet FROM f)"
)

SQL = {
    "findings_by_file": f"WITH {_F} SELECT repo_id, evidence.file AS file, count(*) AS findings, count(*) FILTER (coalesce(status, 'new') NOT IN ('fixed', 'permanently_failed')) AS unresolved, max({_RANK}) AS max_rank, epoch_us(max(found_at)) AS last_found FROM f WHERE evidence.file IS NOT NULL GROUP BY 1, 2",
    "finding_fingerprint": f"WITH {_F} SELECT finding_key, sha256(coalesce({_tidy('category')}, '') || '|' || coalesce(evidence.file, '') || '|' || coalesce(evidence.category_detail, '') || '|' || coalesce(trim(regexp_replace(evidence.snippet, '\\s+', ' ', 'g')), '')) AS fingerprint FROM f",
    "evidence_packet": f"{_PACKET} SELECT finding_key, packet, sha256(packet) AS prefix_hash FROM p",
    "rule_suppression": f"WITH {_F}, r(no, cat, prefix) AS (VALUES (1, 'dead-code', 'lib/'), (3, 'dependency-vuln', NULL), (4, 'llm-review', 'core/')) SELECT finding_key, min(no) AS rule FROM f JOIN r ON r.cat = {_tidy('f.category')} AND (r.prefix IS NULL OR starts_with(coalesce(evidence.file, ''), r.prefix)) GROUP BY 1",
    "duplicate_gate": f"{_PACKET} SELECT finding_key, CASE WHEN row_number() OVER (PARTITION BY packet ORDER BY conf DESC, finding_key) = 1 THEN 'promoted' ELSE 'duplicate' END AS decision FROM p",
    "max_findings_cutoff": f"WITH {_F}, g AS (SELECT repo_id, {_tidy('category')} AS category, {_tidy('finding_id')} AS fid, min((batch_no, finding_key)) AS fst FROM f WHERE finding_id IS NOT NULL GROUP BY 1, 2, 3), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY repo_id, category ORDER BY fst) AS rn FROM g) SELECT repo_id, category, fid, struct_extract(fst, 2) AS finding_key, rn FROM r WHERE rn <= 20",
    "status_by_category": f"WITH {_F}, g AS (SELECT coalesce({_tidy('category')}, 'none') AS category, coalesce(status, 'none') AS status, confidence_score FROM f) SELECT coalesce(category, '*') AS category, coalesce(status, '*') AS status, count(*) AS findings, round(avg(confidence_score), 6) AS confidence FROM g GROUP BY CUBE (category, status)",
    "benchmark_by_category": f"WITH {_F} SELECT coalesce({_tidy('category')}, 'none') AS category, count(*) AS total, count(pr_number) AS prs, count(*) FILTER (merge_outcome = 'merged') AS merged, count(*) FILTER (merge_outcome = 'closed') AS closed, count(*) FILTER (merge_outcome = 'reverted') AS reverted, "
    "round(avg(pr_quality_score), 6) AS quality, CASE WHEN count(pr_number) > 0 THEN round(count(*) FILTER (merge_outcome = 'merged') / count(pr_number), 6) END AS merge_rate FROM f GROUP BY 1",
    "prune_findings": f"WITH {_F}, k AS (SELECT finding_key, repo_id, coalesce(status, 'new') IN ('fixed', 'issue-opened') AS kept, found_at FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY repo_id, kept ORDER BY found_at DESC NULLS LAST, finding_key) AS rn FROM k WHERE kept OR found_at IS NULL OR found_at >= TIMESTAMPTZ '{AS_OF} 00:00:00+00' - INTERVAL 200 DAY) SELECT finding_key, repo_id, kept FROM r WHERE kept OR rn <= 50",
    "group_similar": f"WITH {_F}, g AS (SELECT *, coalesce({_tidy('category')}, 'none') AS cat FROM f) SELECT repo_id, CASE WHEN cat = 'llm-review' THEN 'file:' || coalesce(evidence.file, '') ELSE cat || '|' || coalesce(evidence.category_detail, '') END AS grp, count(*) AS findings, min(finding_key) AS first_key, epoch_us(max(found_at)) AS last_found FROM g GROUP BY 1, 2",
    "latest_template": f"WITH {_F}, g AS (SELECT finding_key, repo_id, {_tidy('category')} AS category, {_EXT} AS ext, found_at, status FROM f WHERE category IS NOT NULL AND found_at IS NOT NULL) "
    "SELECT a.finding_key, arg_max(b.finding_key, (b.found_at, b.finding_key)) AS match_key FROM g a JOIN g b ON a.repo_id = b.repo_id AND a.category = b.category AND a.ext = b.ext AND b.status = 'fixed' AND b.found_at < a.found_at GROUP BY 1",
    "band_match": f"WITH {_F}, s AS (SELECT repo_id, evidence.file AS file, {_tidy('category')} AS category, evidence.line AS line, count(*) AS rows, min(finding_key) AS first_key FROM f WHERE evidence.file IS NOT NULL AND category IS NOT NULL AND evidence.line IS NOT NULL GROUP BY 1, 2, 3, 4) "
    "SELECT a.repo_id, a.file, a.category, a.line AS line_a, b.line AS line_b, a.first_key AS key_a, b.first_key AS key_b FROM s a JOIN s b ON a.repo_id = b.repo_id AND a.file = b.file AND a.category = b.category AND b.line > a.line AND b.line - a.line <= 5",
    "issue_validation": f"WITH {_F} SELECT finding_key, evidence.file AS file, evidence.line AS line, {_tidy('severity')} AS severity, confidence_score AS confidence FROM f WHERE evidence.file IS NOT NULL AND evidence.line > 0 AND {_tidy('severity')} IN ('low', 'medium', 'high', 'critical') AND confidence_score BETWEEN 0 AND 1",
    "sarif_results": f"WITH {_F}, m AS (SELECT *, coalesce(description, '') AS t FROM f) SELECT finding_key, coalesce({_tidy('category')}, 'none') AS rule_id, CASE WHEN {_tidy('severity')} IN ('critical', 'high') THEN 'error' WHEN {_tidy('severity')} = 'medium' THEN 'warning' ELSE 'note' END AS level, "
    "CASE WHEN length(t) > 80 THEN substr(t, 1, 80) || '... (' || (length(t) - 80) || ' more)' ELSE t END AS message, coalesce(evidence.file, '') AS uri, greatest(coalesce(evidence.line, 1), 1) AS start_line FROM m",
    "recurring_categories": f"WITH {_F}, g AS (SELECT DISTINCT repo_id, batch_no, {_tidy('category')} AS category FROM f WHERE category IS NOT NULL AND batch_no IS NOT NULL), b AS (SELECT repo_id, batch_no, row_number() OVER (PARTITION BY repo_id ORDER BY batch_no DESC) AS rn FROM (SELECT DISTINCT repo_id, batch_no FROM g)), "
    "l AS (SELECT * FROM b WHERE rn <= 10), n AS (SELECT repo_id, count(*) AS batches FROM l GROUP BY 1 HAVING count(*) >= 3) SELECT g.repo_id, category, count(*) AS had, any_value(batches) AS batches FROM g JOIN l USING (repo_id, batch_no) JOIN n ON n.repo_id = g.repo_id GROUP BY 1, 2 HAVING count(*) * 2 > any_value(batches)",
    "pr_outcomes": f"WITH {_F} SELECT repo_id, pr_number, count(*) AS findings, max(coalesce(merge_outcome, '')) AS outcome, sum(coalesce(verification.tests_failed, 0)) AS failed FROM f WHERE pr_number IS NOT NULL GROUP BY 1, 2",
}
