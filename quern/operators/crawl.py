"""The crawl priority of files: a sum of rules, each of which leaves a reason where it fires."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import scalars as S


def days(now: Column, then: Column) -> Column:
    """Fractional days between two times; NULL if either is."""
    return (F.unix_micros(now) - F.unix_micros(then)) / 86400e6


def rules(now: Column) -> list[tuple[str, Column, Column]]:
    """(rule, whether it fires, what it adds) in the order in which they are summed. Impacts are fixed values."""
    c = F.col
    age = days(now, c("reviewed_at"))
    reviewed, ttl = c("reviewed_at").isNotNull(), S.ttl_days(c("relpath"))
    again = F.when(c("findings") > 0, 1).otherwise(ttl)  # days until a file may be taken again
    production = c("relpath").rlike("^(src|lib|app|pkg)/")
    return [
        ("never_reviewed", ~reviewed, F.lit(30.0)),
        ("content_changed", c("changed"), F.lit(20.0)),
        ("stale_review_ttl", reviewed & (age >= ttl), F.lit(18.0)),
        ("eligibility_window_open", reviewed & (age >= again), F.lit(5.0)),
        ("neighbor_changed", c("neighbor_changed"), F.lit(6.0)),
        ("unresolved_findings", c("unresolved") > 0, 8.0 * c("unresolved")),
        ("historical_findings", c("findings") > 0, 4.0 * c("findings")),
        ("severity_history", F.lit(True), c("severity_rank") * 1.0),
        ("recent_churn", c("churn") > 0, F.least(c("churn"), F.lit(20)) * 1.0),
        ("file_size", c("lines") > 0, F.least(c("lines") / 100, F.lit(10.0))),
        ("large_file_penalty", c("lines") > 350, -F.least((c("lines") - 350) / 120, F.lit(18.0))),
        ("gini_repeat_penalty", (c("gini") >= 0.35) & (c("selections") > 1), -F.least((c("selections") - 1) * 4 * c("gini"), F.lit(18.0))),
        ("production_code", production, F.lit(2.0)),
        ("recent_review", age < 7, F.when(age < 1, -12.0).when(age < 3, -6.0).otherwise(-3.0)),
        ("stale_review", age >= 7, F.least(age / 7, F.lit(6.0))),
        ("previously_clean", c("clean") & ~c("changed"), F.lit(-2.0)),
        ("test_file", S.is_test(c("relpath")), F.lit(1.0)),
        ("detector_signals", c("signals") > 0, 18.0 * c("signals")),
        ("detector_risk", c("risk") > 0, F.least(c("risk"), F.lit(8)) * 1.0),
        ("detector_confidence", c("confidence") > 0, 10.0 * c("confidence")),
    ]


def scored(inventory: DataFrame, now: Column) -> DataFrame:
    """Adds score and reasons, an array of (rule, impact). ``inventory`` has relpath, lines, reviewed_at, changed,
    findings, unresolved, severity_rank, churn, selections, gini, signals, risk, confidence, neighbor_changed, clean;
    only reviewed_at may be NULL."""
    every = [(name, F.coalesce(fires, F.lit(False)), impact) for name, fires, impact in rules(now)]
    total = F.lit(0.0)
    for _, fires, impact in every:
        total = total + F.when(fires, impact).otherwise(0.0)
    reasons = F.array_compact(F.array(*[F.when(fires, F.struct(F.lit(name).alias("rule"), F.round(impact, 3).alias("impact"))) for name, fires, impact in every]))
    return inventory.withColumn("score", F.round(total, 3)).withColumn("reasons", reasons)
