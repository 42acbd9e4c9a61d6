"""What Python source says, as rows of one kind for all relations, as UDTFs, and the registry that picks by extension."""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.functions import udtf

SYMBOLS = "name string, kind string, start_line int, end_line int"
IMPORTS = "module string, bound string, level int, line int"


def _tree(source: str | None) -> ast.Module | None:
    if not source:
        return None
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            return ast.parse(source.removeprefix("﻿"))
        except (SyntaxError, ValueError, RecursionError):
            return None


#: Rows of ``facts``: kind (symbol, import, reference, export, signal), name, what it is of (kind of symbol, module of an
#: import), the name that an import binds, the level of a relative one, lines, and its place among those of its kind.
FACT = "kind string, name string, of string, bound string, level int, start_line int, end_line int, place int"
Fact = tuple[str, str | None, str | None, str | None, int | None, int | None, int | None, int]


def python_facts(source: str | None) -> Iterator[Fact]:
    """Everything the queries ask of a Python file, from one parse.

    Symbols are top-level functions and classes, and methods one level in as Class.method. An import has the name it
    takes (NULL for a whole module) and the name it binds: an alias wins, ``import a.b`` binds a, star imports bind
    nothing. References are names read outside imports, exports the strings of a module-level ``__all__`` list. Signals
    are those of the syntax tree. What does not parse has one signal only.
    """
    tree = _tree(source)
    if tree is None:
        if source and source.strip():
            yield "signal", "syntax_error", None, None, None, 1, None, 1
        return
    function = ast.FunctionDef | ast.AsyncFunctionDef
    place = 0
    for node in tree.body:
        if isinstance(node, function | ast.ClassDef):
            place += 1
            yield "symbol", node.name, "class" if isinstance(node, ast.ClassDef) else "function", None, None, node.lineno, node.end_lineno, place
            for inner in node.body if isinstance(node, ast.ClassDef) else ():
                if isinstance(inner, function):
                    place += 1
                    yield "symbol", f"{node.name}.{inner.name}", "method", None, None, inner.lineno, inner.end_lineno, place
        elif isinstance(node, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in node.targets) and isinstance(node.value, ast.List):
            for i, item in enumerate(node.value.elts, 1):
                if isinstance(item, ast.Constant) and isinstance(item.value, str):
                    yield "export", item.value, None, None, None, item.lineno, None, i
    names, place, n, functions, classes = {}, 0, 0, 0, 0
    for node in ast.walk(tree):
        functions += isinstance(node, function)
        classes += isinstance(node, ast.ClassDef)
        signal = None
        if isinstance(node, ast.Name):
            names.setdefault(node.id, node.lineno)
        elif isinstance(node, ast.Import):
            for a in node.names:
                place += 1
                yield "import", None, a.name, a.asname or a.name.split(".")[0], 0, node.lineno, None, place
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                if a.name != "*":
                    place += 1
                    yield "import", a.name, node.module or "", a.asname or a.name, node.level, node.lineno, None, place
        elif isinstance(node, ast.ExceptHandler) and node.type is None:
            signal = "bare_except"
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in ("eval", "exec"):
            signal = "dynamic_execution"
        elif isinstance(node, ast.Try) and not node.handlers:
            signal = "empty_try_handlers"
        if signal:
            n += 1
            yield "signal", signal, None, None, None, node.lineno, None, n
    for i, name in enumerate(sorted(names), 1):
        yield "reference", name, None, None, None, names[name], None, i
    for found, name in ((functions >= 12, "high_function_count"), (classes >= 6, "high_class_count")):
        if found:
            n += 1
            yield "signal", name, None, None, None, 1, None, n


def node_chain(source: str | None, first: int, last: int) -> list[str]:
    """The kinds of the syntax nodes that cover a span of lines, from the outermost to the innermost; [] without a tree."""
    tree = _tree(source)
    out: list[str] = []
    node: ast.AST | None = tree
    while node is not None:
        out.append(type(node).__name__)
        node = next((n for n in ast.iter_child_nodes(node) if getattr(n, "lineno", last + 1) <= first and (getattr(n, "end_lineno", None) or 0) >= last), None)
    return out


def node_chains(spans: DataFrame) -> DataFrame:
    """(id, chain) of spans (id, text, first, last), the kinds joined by >; texts that do not parse have NULL."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = (c.to_pylist() for c in batch.columns[1:])
            chains = [">".join(node_chain(t, a, b)) or None if a is not None and b is not None else None for t, a, b in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chains, type=pa.string())], names=["id", "chain"])

    return spans.select(spans["id"].cast("long").alias("id"), "text", spans["first"].cast("int").alias("first"), spans["last"].cast("int").alias("last")).mapInArrow(look, "id long, chain string")


def outline_facts(symbol: re.Pattern[str], imported: re.Pattern[str]) -> Callable[[str | None], Iterator[Fact]]:
    """Facts of a language without a parser here: symbols and imports as declarations at the start of lines tell them.

    Of ``symbol``'s groups the first that is there names the kind, its text the symbol; ``imported`` has the group module.
    """

    def facts(source: str | None) -> Iterator[Fact]:
        text = source or ""
        for i, m in enumerate(symbol.finditer(text), 1):
            kind = m.lastgroup
            yield "symbol", m.group(kind), kind.rstrip("_"), None, None, text.count("\n", 0, m.start(kind)) + 1, None, i
        for i, m in enumerate(imported.finditer(text), 1):
            yield "import", None, m.group("module"), m.group("module").rsplit("/", 1)[-1], 0, text.count("\n", 0, m.start("module")) + 1, None, i

    return facts


_SCRIPT = outline_facts(
    re.compile(r"^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:(?:async\s+)?function\s*\*?\s*(?P<function>[\w$]+)|class\s+(?P<class_>[\w$]+)|interface\s+(?P<interface>[\w$]+)|(?:const|let|var)\s+(?P<function_>[\w$]+)\s*=\s*(?:async\s*)?(?:function\b|\([^()\n]*\)\s*(?::[^=\n]+)?=>))", re.M),
    re.compile(r"""^(?:import|export)\b(?:[^\n;"']*?\bfrom)?\s*["'](?P<module>[^"'\n]+)["']""", re.M),
)
_GO = outline_facts(
    re.compile(r"^func\s+(?:\([^)\n]*\)\s*(?P<method>\w+)|(?P<function>\w+))|^type\s+(?P<class>\w+)\s+(?:struct|interface)\b", re.M),
    re.compile(r"^(?:import\s+(?:[\w.]+\s+)?|\s+(?:[\w.]+\s+)?)\"(?P<module>[\w./-]+)\"\s*$", re.M),
)

#: Facts by extension, first registered wins; files of other extensions yield no rows.
FACTS: dict[str, Callable[[str | None], Iterator[Fact]]] = {".py": python_facts, ".js": _SCRIPT, ".jsx": _SCRIPT, ".ts": _SCRIPT, ".tsx": _SCRIPT, ".go": _GO}


def register(extension: str, facts: Callable[[str | None], Iterator[Fact]]) -> bool:
    """Add a language; one that is there already stays, and False says so."""
    return FACTS.setdefault(extension, facts) is facts


def facts(files: DataFrame, *keep: str) -> DataFrame:
    """(keep, FACT) of files (keep, ext, text), each parsed once, in Arrow batches; NULL texts yield nothing."""
    known, names = dict(FACTS), [x.split()[0] for x in FACT.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32()}

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, (ext, text) in enumerate(zip(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist(), strict=True)):
                got = list(known[ext](text)) if ext in known and text is not None else []
                rows += got
                at += [i] * len(got)
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            own = batch.select(list(keep)).take(pa.array(at, type=pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(c, type=kinds[x.split()[1]]) for c, x in zip(cols, FACT.split(", "), strict=True))], names=[*keep, *names])

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in files.select(*keep).schema.fields] + [FACT])
    return files.select(*keep, "ext", "text").mapInArrow(look, schema)


@udtf(returnType=SYMBOLS)
class PythonSymbols:
    """Top-level functions and classes, and methods one level in; nested ones are left out."""

    def eval(self, source: str):
        for f in python_facts(source):
            if f[0] == "symbol":
                yield f[1].rsplit(".", 1)[-1], f[2], f[5], f[6]


@udtf(returnType=IMPORTS)
class PythonImports:
    """Names that imports bind: an alias wins, ``import a.b`` binds a, star imports bind nothing."""

    def eval(self, source: str):
        for f in python_facts(source):
            if f[0] == "import":
                yield f[2] if f[1] is None else f"{f[2]}.{f[1]}", f[3], f[4], f[5]


@udtf(returnType="name string, exported boolean")
class PythonReferences:
    """Names that are read outside imports, and those that a module-level ``__all__`` list exports."""

    def eval(self, source: str):
        for f in python_facts(source):
            if f[0] in ("reference", "export"):
                yield f[1], f[0] == "export"


@udtf(returnType="rule string, line int")
class PythonSignals:
    """Bare excepts, eval and exec calls, tries without handlers, many functions or classes, syntax errors."""

    def eval(self, source: str):
        for f in python_facts(source):
            if f[0] == "signal":
                yield f[1], f[5]


#: Adapters by extension, first registered wins; languages without one yield no rows.
ADAPTERS = {".py": {"symbols": PythonSymbols, "imports": PythonImports, "references": PythonReferences, "signals": PythonSignals}}
