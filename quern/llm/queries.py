"""The queries pN_... of this subpackage, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import handwritten, history, leakage, mixing, parsing, secrets, spam, splitting
from . import near_duplicates as nd
from .common import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = nd.near_duplicate_pairs(nd.finding_texts(table(spark, sf_dir, "findings")))
    return out.select(out.id_a.alias("finding_key_a"), out.id_b.alias("finding_key_b"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = nd.near_duplicate_groups(nd.finding_texts(table(spark, sf_dir, "findings")))
    return out.withColumnRenamed("id", "finding_key")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.replay(history.arrivals(table(spark, sf_dir, "findings")))


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split(table(spark, sf_dir, "parse_results"), table(spark, sf_dir, "split_limits"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_pieces(spark, sf_dir).where("piece_no = 1").select("file_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.parse_states(table(spark, sf_dir, "parse_results")).where("state <> 'ok'").select("file_id")


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.parse_rates(table(spark, sf_dir, "parse_results"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_kinds(spark, sf_dir).where("kind is not null").select("file_id")


def p5_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handwritten.kinds(table(spark, sf_dir, "parse_results"))


def p5_shared_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handwritten.shared_rules(table(spark, sf_dir, "parse_results"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.found_lines(table(spark, sf_dir, "parse_results"))


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.redacted(table(spark, sf_dir, "parse_results"))


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), leakage.item_fields(table(spark, sf_dir, "eval_items")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = mixing.sized_by_words(table(spark, sf_dir, "documents"))
    return mixing.shares(sized, table(spark, sf_dir, "mix_targets")).where("short").select("source")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(mixing.token_counts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(mixing.token_counts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.flagged(table(spark, sf_dir, "documents")).select("doc_id")


def p9_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.flagged(table(spark, sf_dir, "documents"))


def p9_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.crawl_shapes(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("p") and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from .sql import SQL

    return dict(SQL)
