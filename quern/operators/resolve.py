"""From imports and references of source files to the files and symbols that they mean.

Works on rows of ``functions.pysource.facts`` with repo_id and relpath. All steps are equi-joins within a repository.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _base(relpath: str = "relpath"):
    """The segments of the module that an import names, from the root of the repository; NULL if there is none.

    A relative import starts at the folder of its file and goes up one folder for each level beyond the first; one that
    goes up beyond the root, or that names nothing, means no module.
    """
    folders = F.slice(F.split(relpath, "/"), F.lit(1), F.size(F.split(relpath, "/")) - 1)
    up = F.slice(folders, F.lit(1), F.greatest(F.size(folders) - F.col("level") + 1, F.lit(0)))
    module = F.filter(F.split(F.coalesce("of", F.lit("")), r"\."), lambda x: x != "")
    parts = F.when(F.col("level") > 0, F.when(F.col("level") <= F.size(folders), F.concat(up, module))).otherwise(module)
    return F.when(F.size(parts) > 0, F.array_join(parts, "/"))


def targets(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, relpath, bound, place, target, symbol): the file that each import means, and the name taken from it.

    ``from m import n`` means the file m/n.py if there is one (and then no name), else m.py, else m/__init__.py.
    ``import m`` means m.py or m/__init__.py, and no name. Imports of anything else give no row.
    """
    i = facts.where("kind = 'import' and relpath like '%.py'").select("repo_id", "relpath", "bound", "place", "name", _base().alias("base")).where("base is not null")
    tried = F.array(F.when(F.col("name").isNotNull(), F.concat_ws("/", "base", F.concat("name", F.lit(".py")))), F.concat("base", F.lit(".py")), F.concat("base", F.lit("/__init__.py")))
    i = i.select("repo_id", "relpath", "bound", "place", "name", F.posexplode(tried).alias("rank", "target")).where("target is not null")
    known = files.where("relpath is not null").select("repo_id", F.col("relpath").alias("target")).distinct()
    best = i.join(known, ["repo_id", "target"]).groupBy("repo_id", "relpath", "bound", "place").agg(F.min(F.struct("rank", "target", "name")).alias("b"))
    return best.select("repo_id", "relpath", "bound", "place", "b.target", F.when(F.col("b.rank") > 0, F.col("b.name")).alias("symbol"))


def edges(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, caller, callee), distinct, no symbol with itself.

    A name that a file refers to means what an import of the file binds to it (of several such imports the last that
    leads to a symbol), or else the symbol of that name in the file itself. Every symbol of the file calls every symbol so
    meant. Imports of whole modules, and of names that no symbol has, mean no symbol.
    """
    python = facts.where("relpath like '%.py'")
    symbols = python.where("kind = 'symbol'").select("repo_id", "relpath", "name").distinct()
    sid = F.concat_ws("::", "relpath", "name")
    taken = targets(python, files).where("symbol is not null")
    has = symbols.select("repo_id", F.col("relpath").alias("target"), F.col("name").alias("symbol"))
    bound = taken.join(has, ["repo_id", "target", "symbol"], "left_semi")
    bound = bound.groupBy("repo_id", "relpath", F.col("bound").alias("name")).agg(F.max_by(F.concat_ws("::", "target", "symbol"), "place").alias("imported"))
    local = symbols.select("repo_id", "relpath", "name", sid.alias("own"))
    refs = python.where("kind = 'reference'").select("repo_id", "relpath", "name").distinct()
    meant = refs.join(bound, ["repo_id", "relpath", "name"], "left").join(local, ["repo_id", "relpath", "name"], "left")
    meant = meant.select("repo_id", "relpath", F.coalesce("imported", "own").alias("callee")).where("callee is not null").distinct()
    callers = symbols.select("repo_id", "relpath", sid.alias("caller"))
    return callers.join(meant, ["repo_id", "relpath"]).where("caller <> callee").select("repo_id", "caller", "callee").distinct()
