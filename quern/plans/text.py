"""Queries on what source files say: symbols, imports, signals, import resolution, and the edges that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import scalars as S
from quern.functions.pysource import FACTS, facts, node_chains
from quern.operators import resolve
from quern.sources.tables import table, texts


def source_facts(spark: SparkSession, d: str) -> DataFrame:
    """Every symbol, import, reference, export and signal of the files of a known language, each file parsed once."""
    f = texts(spark, d).where("relpath is not null").select("file_id", "repo_id", "relpath", S.extension(F.col("relpath")).alias("ext"), "text")
    return facts(f.where(F.col("ext").isin(*FACTS)), "file_id", "repo_id", "relpath")


def _python(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return source_facts(spark, d).where((F.col("kind") == kind) & (S.extension(F.col("relpath")) == ".py"))


def _module() -> Column:
    return F.concat_ws(".", F.nullif("of", F.lit("")), "name")


def python_symbols(spark: SparkSession, d: str) -> DataFrame:
    s = _python(spark, d, "symbol")
    return s.select("file_id", "repo_id", F.concat_ws("::", "relpath", "name").alias("symbol_id"), F.col("of").alias("kind"), "start_line", "end_line")


def outline_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of files of JavaScript, TypeScript and Go, by their declarations."""
    s = source_facts(spark, d).where((F.col("kind") == "symbol") & (S.extension(F.col("relpath")) != ".py"))
    return s.select("file_id", "repo_id", F.concat_ws("::", "relpath", "name").alias("symbol_id"), F.col("of").alias("kind"), "start_line")


def python_imports(spark: SparkSession, d: str) -> DataFrame:
    return _python(spark, d, "import").select("file_id", "repo_id", "relpath", _module().alias("module"), "bound", "level", F.col("start_line").alias("line"))


def unused_imports(spark: SparkSession, d: str) -> DataFrame:
    """Imports that the file neither reads nor exports, with the line around (one before and after)."""
    f = source_facts(spark, d).where(S.extension(F.col("relpath")) == ".py")
    read = F.max(F.col("kind").isin("reference", "export"))
    used = f.where("kind in ('import', 'reference', 'export')").groupBy("file_id", F.when(F.col("kind") == "import", F.col("bound")).otherwise(F.col("name")).alias("bound")).agg(
        read.alias("used"), F.collect_list(F.when(F.col("kind") == "import", F.struct("relpath", _module().alias("module"), F.col("start_line").alias("line")))).alias("imports")
    )
    unused = used.where("not used and bound <> 'annotations'").select("file_id", "bound", F.explode("imports").alias("i")).select("file_id", "bound", "i.*")
    lines = texts(spark, d).select("file_id", "lines")
    around = F.array_join(F.slice("lines", F.greatest(F.col("line") - 1, F.lit(1)), F.when(F.col("line") > 1, 3).otherwise(2)), "\n")
    return unused.join(lines, "file_id").select("file_id", "relpath", "bound", "module", "line", around.alias("around"))


def unused_imports_by_file(spark: SparkSession, d: str) -> DataFrame:
    """Per file its unused imports in order, the first ten. Private names count as used, and so does a name that another
    file of the repository takes from this one, or whose module another file imports whole."""
    u = unused_imports(spark, d).where(~F.col("bound").startswith("_"))
    repo = texts(spark, d).select("file_id", "repo_id")
    i = _python(spark, d, "import").select("repo_id", F.col("relpath").alias("other"), "of", "name")
    taken = i.where("name is not null").select("repo_id", F.element_at(F.split("of", r"\."), -1).alias("stem"), F.col("name").alias("bound"), "other")
    whole = i.where("name is null").select("repo_id", F.substring_index("of", ".", 1).alias("stem"), "other")
    u = u.join(repo, "file_id").withColumn("stem", S.stem(F.col("relpath")))
    u = u.join(taken, (u.repo_id == taken.repo_id) & (u.stem == taken.stem) & (u.bound == taken.bound) & (u.relpath != taken.other), "left_anti")
    u = u.join(whole, (u.repo_id == whole.repo_id) & (u.stem == whole.stem) & (u.relpath != whole.other), "left_anti")
    names = F.array_sort(F.collect_set("bound"))
    return u.groupBy("file_id", "relpath").agg(F.slice(names, 1, 10).alias("first"), F.size(names).alias("unused")).select("file_id", "relpath", F.array_join("first", ",").alias("names"), "unused")


def resolved_imports(spark: SparkSession, d: str) -> DataFrame:
    """Imports with the file of their repository that they mean, and the name taken from it, if any."""
    return resolve.targets(source_facts(spark, d), texts(spark, d).select("repo_id", "relpath"))


def derived_edges(spark: SparkSession, d: str) -> DataFrame:
    """(repo_id, caller, callee): every symbol of a file with every symbol that the file refers to."""
    return resolve.edges(source_facts(spark, d), texts(spark, d).select("repo_id", "relpath"))


def finding_chains(spark: SparkSession, d: str) -> DataFrame:
    """For each finding in a Python file the kinds of syntax nodes around its line, in the newest delivery of the file."""
    newest = F.max_by(F.struct("file_id", F.array_join("lines", "\n").alias("text")), F.struct("last_seen_at", "file_id"))
    f = texts(spark, d).where(S.extension(F.col("relpath")) == ".py").groupBy("repo_id", F.col("relpath").alias("file")).agg(newest.alias("v")).select("repo_id", "file", "v.text")
    g = table(spark, d, "findings").where("finding_key is not null and evidence.line is not null").select(F.col("finding_key").alias("id"), "repo_id", F.col("evidence.file").alias("file"), F.col("evidence.line").alias("first"))
    return node_chains(g.join(f, ["repo_id", "file"]).select("id", "text", "first", F.col("first").alias("last"))).withColumnRenamed("id", "finding_key")


def module_edges(spark: SparkSession, d: str) -> DataFrame:
    """(repo_id, source, target): a file imports a module whose first segment is the stem of another file of its
    repository; of several files with a stem the last by path."""
    first = F.substring_index(F.coalesce(F.nullif("of", F.lit("")), "name"), ".", 1)
    i = _python(spark, d, "import").where("level = 0").select("repo_id", F.col("relpath").alias("source"), first.alias("stem")).distinct()
    files = texts(spark, d).where(S.extension(F.col("relpath")) == ".py").groupBy("repo_id", S.stem(F.col("relpath")).alias("stem")).agg(F.max("relpath").alias("target"))
    return i.join(files, ["repo_id", "stem"]).where("source <> target").select("repo_id", "source", "target").distinct()


def python_signals(spark: SparkSession, d: str) -> DataFrame:
    return _python(spark, d, "signal").select("file_id", "repo_id", "relpath", F.col("name").alias("rule"), F.col("start_line").alias("line"))


QUERIES = {f.__name__: f for f in (python_symbols, outline_symbols, python_imports, unused_imports, unused_imports_by_file, resolved_imports, derived_edges, module_edges, finding_chains, python_signals)}
SQL: dict[str, str] = {}
