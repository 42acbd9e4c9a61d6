"""A small source tree with all that is to be told from it, so that extraction and resolution have SQL to equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.pysource import facts, node_chains
from quern.operators import resolve

TREE = {
    "app/util.py": "def helper(): pass\nclass Tool:\n    def run(self): return helper()\n",
    "app/__init__.py": "VERSION = 1\ndef boot(): pass\n",
    "app/main.py": "from app.util import helper as h, missing\nfrom . import boot\nfrom .util import Tool\nimport app.util\ndef go():\n    h(); Tool(); boot(); missing()\n",
    "app/sub/deep.py": "from ..util import helper\nfrom app import util\nfrom ...gone import x\nfrom ....gone import y\ndef dig(): return helper, util, x, y\n",
    "app/shadow.py": "from os import path\nfrom app.util import Tool\ndef Tool(): pass\ndef path(): return Tool\n",
    "app/broken.py": "def (\n",
    "top.py": "from app import *\nfrom app.util import helper\nfrom app.util import Tool as helper\ndef use(): helper()\n",
}
EDGES = {
    ("app/util.py::Tool", "app/util.py::helper"), ("app/util.py::Tool.run", "app/util.py::helper"),
    ("app/main.py::go", "app/util.py::helper"), ("app/main.py::go", "app/util.py::Tool"), ("app/main.py::go", "app/__init__.py::boot"),
    ("app/sub/deep.py::dig", "app/util.py::helper"),
    ("app/shadow.py::Tool", "app/util.py::Tool"), ("app/shadow.py::path", "app/util.py::Tool"),
    ("top.py::use", "app/util.py::Tool"),
}
SYMBOLS = [
    ("app/util.py", "helper", "function", 1, 1), ("app/util.py", "Tool", "class", 2, 3), ("app/util.py", "Tool.run", "method", 3, 3), ("app/__init__.py", "boot", "function", 2, 2), ("app/main.py", "go", "function", 5, 6),
    ("app/sub/deep.py", "dig", "function", 5, 5), ("app/shadow.py", "Tool", "function", 3, 3), ("app/shadow.py", "path", "function", 4, 4), ("top.py", "use", "function", 4, 4),
]
IMPORTS = [
    ("app/main.py", "h", "app/util.py", "helper"), ("app/main.py", "missing", "app/util.py", "missing"), ("app/main.py", "boot", "app/__init__.py", "boot"), ("app/main.py", "Tool", "app/util.py", "Tool"), ("app/main.py", "app", "app/util.py", None),
    ("app/sub/deep.py", "helper", "app/util.py", "helper"), ("app/sub/deep.py", "util", "app/util.py", None), ("app/shadow.py", "Tool", "app/util.py", "Tool"), ("top.py", "helper", "app/util.py", "helper"), ("top.py", "helper", "app/util.py", "Tool"),
]


def tree(spark: SparkSession, files: dict[str, str | None] = TREE, repos: tuple[int, ...] = (1,)) -> tuple[DataFrame, DataFrame]:
    """The facts of a tree that several repositories have, and its files."""
    f = spark.createDataFrame([(r, p, "." + p.rsplit(".", 1)[1], t) for r in repos for p, t in files.items()], "repo_id int, relpath string, ext string, text string")
    return facts(f, "repo_id", "relpath"), f.select("repo_id", "relpath")


def example_symbols(spark: SparkSession, d: str) -> DataFrame:
    return tree(spark)[0].where("kind = 'symbol'").select("relpath", "name", F.col("of").alias("kind"), "start_line", "end_line")


def example_imports(spark: SparkSession, d: str) -> DataFrame:
    return resolve.targets(*tree(spark)).select("relpath", "bound", "target", "symbol")


def example_edges(spark: SparkSession, d: str) -> DataFrame:
    return resolve.edges(*tree(spark)).select("caller", "callee")


CHAINS = [(1, "Module>ClassDef>FunctionDef>Return>Call>Name"), (2, "Module>FunctionDef>Return>Tuple>Name"), (3, "Module>FunctionDef"), (4, None)]


def example_chains(spark: SparkSession, d: str) -> DataFrame:
    spans = [(1, TREE["app/util.py"], 3, 3), (2, TREE["app/sub/deep.py"], 5, 5), (3, TREE["app/main.py"], 5, 6), (4, TREE["app/broken.py"], 1, 1)]
    return node_chains(spark.createDataFrame(spans, "id long, text string, first int, last int"))


def _values(names: str, rows) -> str:
    value = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else f"'{x}'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(value, r)) + ')' for r in sorted(rows, key=str))}) t({names})"


QUERIES = {f.__name__: f for f in (example_symbols, example_imports, example_edges, example_chains)}
SQL = {"example_symbols": _values("relpath, name, kind, start_line, end_line", SYMBOLS), "example_imports": _values("relpath, bound, target, symbol", IMPORTS), "example_edges": _values("caller, callee", EDGES), "example_chains": _values("id, chain", CHAINS)}
