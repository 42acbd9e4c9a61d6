"""Readers of stored state: findings, crawl state, policies, configuration, audit reports, registries, shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import scalars as S

FINDING = "finding_id:string,severity:string,category:string,description:string,status:string,found_at:string,evidence:struct<file:string,line:int,category_detail:string>"
FILE_STATE = "struct<content_hash:string,last_crawl_hash:string,last_crawled_at:string,last_result:string,next_eligible_at:string>"


def parsed_time(c: Column) -> Column:
    """ISO times with Z, an offset or no zone (UTC); anything else is NULL."""
    return F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00"))


def findings_json(spark: SparkSession, path: str) -> DataFrame:
    """Finding files, each an array of findings or an object with one under ``findings``; unreadable files give no rows."""
    raw = spark.read.text(path, wholetext=True)
    bare = F.from_json("value", f"array<struct<{FINDING}>>")
    held = F.from_json("value", f"struct<findings:array<struct<{FINDING}>>>")["findings"]
    array = F.trim("value").startswith("[")
    return raw.select(F.explode(F.when(array, bare).otherwise(held)).alias("f")).where("f is not null").select("f.*").withColumn("found_at", parsed_time(F.col("found_at")))


def crawl_state(spark: SparkSession, path: str) -> DataFrame:
    """(path, state fields) of a document {"files": {path: {...}}}; a file without ``files`` gives no rows."""
    raw = spark.read.text(path, wholetext=True)
    files = F.from_json("value", f"struct<files:map<string,{FILE_STATE}>>")["files"]
    return raw.select(F.explode(files).alias("path", "s")).select("path", "s.*")


def merged_config(defaults: dict[str, str], overrides: Column, known: Column | None = None) -> Column:
    """Defaults with the overrides of known keys on top, as one map column."""
    base = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    allowed = known if known is not None else F.array(*[F.lit(k) for k in defaults])
    picked = F.map_filter(F.coalesce(overrides, F.expr("cast(map() as map<string,string>)")), lambda k, v: F.array_contains(allowed, k) & v.isNotNull())
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(picked), k)), picked)


def duration_seconds(c: Column) -> Column:
    """15m and 2h as seconds; anything else, and nothing above zero, is NULL."""
    n = F.regexp_extract(c, r"^(\d+)[mh]$", 1).try_cast("int")
    return F.when(n > 0, n * F.when(c.endswith("m"), 60).otherwise(3600))


def audit_json(spark: SparkSession, path: str) -> DataFrame:
    """Vulnerabilities of dependency audits: {"dependencies": [{name, version, vulns: [{id, description}]}]}."""
    raw = spark.read.text(path, wholetext=True)
    deps = F.from_json("value", "struct<dependencies:array<struct<name:string,version:string,vulns:array<struct<id:string,description:string>>>>>")["dependencies"]
    v = raw.select(F.explode(deps).alias("d")).select("d.name", "d.version", F.explode("d.vulns").alias("v")).select("name", "version", "v.id", "v.description")
    return v.withColumn("severity", S.told_severity(F.col("description")))


def npm_audit_json(spark: SparkSession, path: str) -> DataFrame:
    """npm audits: the ``advisories`` map of version 1, or else the ``vulnerabilities`` map of version 2."""
    raw = spark.read.text(path, wholetext=True)
    doc = F.from_json("value", "struct<advisories:map<string,struct<module_name:string,severity:string,title:string>>,vulnerabilities:map<string,struct<name:string,severity:string>>>")
    raw = raw.select(doc["advisories"].alias("v1"), doc["vulnerabilities"].alias("v2"))
    level = lambda c: F.coalesce(S.lookup({"critical": "critical", "high": "high", "moderate": "medium", "low": "low"}, c), F.lit("medium"))
    one = raw.select(F.explode("v1").alias("id", "a")).select("id", F.col("a.module_name").alias("name"), level(F.col("a.severity")).alias("severity"))
    two = raw.where("v1 is null or size(v1) = 0").select(F.explode("v2").alias("id", "a")).select("id", F.coalesce("a.name", "id").alias("name"), level(F.col("a.severity")).alias("severity"))
    return one.unionByName(two)


def markdown_rows(texts: DataFrame) -> DataFrame:
    """(id, section, pos, cells) of the pipe-table rows of Markdown texts (id, text), under the heading they follow."""
    from pyspark.sql.window import Window

    lines = texts.select("id", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line"))
    head = F.when(F.col("line").rlike(r"^#+\s"), F.regexp_replace("line", r"^#+\s+", ""))
    w = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)  # a window per document
    rows = lines.withColumn("section", F.last(head, ignorenulls=True).over(w)).where(F.col("line").rlike(r"^\s*\|.*\|\s*$") & ~F.col("line").rlike(r"^[\s|:-]+$"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    return rows.select("id", "section", "pos", cells.alias("cells"))


#: Fixed: folders that hold no source of a repository's own.
PRUNED = (".git", "__pycache__", ".venv", "venv", "node_modules", "build", "dist")


def source_files(spark: SparkSession, path: str, glob: str = "*", tracked: DataFrame | None = None) -> DataFrame:
    """(path, bytes, hash) of the source files of a tree, without pruned and hidden folders and generated files.

    With ``tracked`` (path), the files that version control lists, only these count and folders need not be pruned.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    rel = F.regexp_replace("path", "^file:/+|^[a-z0-9]+://[^/]*/", "/")
    root = rel.substr(F.lit(len(path.removeprefix("file://").rstrip("/")) + 2), F.lit(1 << 20)) if path.startswith(("file://", "/")) else rel
    f = raw.select(root.alias("rel"), F.col("path"), "content")
    if tracked is not None:
        f = f.join(tracked.select(F.col("path").alias("rel")).distinct(), "rel", "left_semi")
    else:
        f = f.where(~F.col("rel").rlike("(^|/)(" + "|".join(p.replace(".", r"\.") for p in PRUNED) + r"|\.[^/]+)/"))
    f = f.where(S.is_source(F.col("rel")) & ~S.is_hidden(F.col("rel")) & ~S.is_generated(F.col("rel")))
    return f.select("path", F.col("content").alias("bytes"), F.sha2("content", 256).alias("hash"))


def json_array(c: Column) -> Column:
    """The JSON array in a text: without code fences, or else from its first [ to its last ]."""
    bare = F.regexp_replace(c, r"(?s)^\s*```[a-z]*\s*|\s*```\s*$", "")
    return F.when(F.trim(bare).startswith("["), F.trim(bare)).otherwise(F.nullif(F.regexp_extract(c, r"(?s)(\[.*\])", 1), F.lit("")))


def first_existing(spark: SparkSession, candidates: list[str]) -> str | None:
    """The first of several places that is there: where an older layout may still be in use."""
    for c in candidates:
        at = spark._jvm.org.apache.hadoop.fs.Path(c)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return c
    return None


def policies(defaults: DataFrame, overrides: DataFrame, modes: tuple[str, ...] = ("fix", "issue-only", "confirm", "disabled")) -> DataFrame:
    """Per category its policy: defaults (category, enabled, mode, min_confidence, max_findings) under overrides of the
    same names as texts. An override that is not of its column's type, or whose category is unknown, does not count; of
    several for a category the greatest value holds."""
    o = overrides.select(F.col("category"), F.col("enabled").try_cast("boolean").alias("e"), F.col("mode").alias("m"), F.col("min_confidence").try_cast("double").alias("c"), F.col("max_findings").try_cast("int").alias("f"))
    o = o.groupBy("category").agg(*[F.max(x).alias(x) for x in "emcf"])
    j = defaults.join(o, "category", "left")
    mode = F.when(F.col("m").isin(*modes), F.col("m"))
    return j.select("category", F.coalesce("e", "enabled").alias("enabled"), F.coalesce(mode, F.col("mode")).alias("mode"), F.coalesce(F.when(F.col("c").between(0, 1), F.col("c")), F.col("min_confidence")).alias("min_confidence"),
        F.coalesce(F.when(F.col("f") > 0, F.col("f")), F.col("max_findings")).alias("max_findings"))


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(path, document) of JSON files under a glob: task retrospectives, templates, value tables, benchmark tasks. Files
    that are no JSON object of the schema give no row."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", schema).alias("document"), F.trim("value").alias("v"))
    return raw.where(F.col("document").isNotNull() & F.try_parse_json("v").isNotNull() & F.col("v").startswith("{")).select("path", "document.*")


CLUSTER = "cluster_id:string,canonical_fingerprint:string,member_fingerprints:array<string>,simhash_signature:string,embedding_centroid:array<double>,first_seen:string,last_seen:string,occurrence_count:int"


def clusters_json(spark: SparkSession, path: str, version: str) -> DataFrame:
    """Clusters of a document {"schema_version", "clusters": [...]}; another version gives no rows, and so does an entry
    that lacks a field. Signatures are numbers, or texts of hexadecimal digits."""
    raw = spark.read.text(path, wholetext=True)
    doc = F.from_json("value", f"struct<schema_version:string,clusters:array<struct<{CLUSTER}>>>")
    c = raw.select(doc.alias("d")).where(F.col("d.schema_version") == version).select(F.explode("d.clusters").alias("c")).select("c.*")
    quoted = F.col("simhash_signature").rlike("^(0x)?[0-9a-fA-F]{16}$")
    whole = F.when(quoted, F.conv(F.regexp_replace("simhash_signature", "^0x", ""), 16, -10)).otherwise(F.col("simhash_signature")).try_cast("decimal(20,0)")
    signed_ = F.when(whole > 2**63 - 1, whole - F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(whole).cast("long")
    need = ["cluster_id", "canonical_fingerprint", "member_fingerprints", "first_seen", "last_seen", "occurrence_count"]
    return c.withColumn("simhash_signature", signed_).dropna(subset=[*need, "simhash_signature"])


def registry(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, enabled) of a registry {"repos": [...]} or [...]; rows without a path are dropped."""
    raw = spark.read.text(path, wholetext=True)
    row = "struct<path:string,name:string,enabled:boolean>"
    array = F.trim("value").startswith("[")
    rows = F.when(array, F.from_json("value", f"array<{row}>")).otherwise(F.from_json("value", f"struct<repos:array<{row}>>")["repos"])
    return raw.select(F.explode(rows).alias("r")).select("r.*").where("path is not null and path <> ''")


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    """(number, state, merged_at, created_at, title) of a feed of pull requests or issues, one JSON object a line."""
    raw = spark.read.schema("number long, state string, mergedAt string, createdAt string, title string").json(path)
    return raw.where("number is not null").select("number", F.lower("state").alias("state"), parsed_time(F.col("mergedAt")).alias("merged_at"), parsed_time(F.col("createdAt")).alias("created_at"), "title")


def listing(files: DataFrame, most: int = 200, blocked: tuple[str, ...] = (".git",)) -> DataFrame:
    """The first paths in order, without those of blocked segments."""
    return files.where(S.inside(F.col("path"), blocked)).select("path").distinct().orderBy("path").limit(most)
