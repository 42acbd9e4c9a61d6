"""Problem 4: source files that do not parse, per file and as rates.

Every file is read by the grammar that its extension claims (py, js, ts, go, json). What that grammar refuses is tried
by the others, in the order in which a ranking by tokens finds them likely: a foreign parse means a wrong extension,
none at all a corrupt file.

Python and JSON are read by the interpreter's own parsers. For ECMAScript modules, TypeScript and Go there are grammars
here, written for speed over many alike files: a file is cut into tokens by one regular expression; brackets are matched;
each bracket's content becomes one short string of token kinds, in which inner brackets are single characters. Such a
string is parsed once per worker, whatever the number of files it recurs in.
"""

from __future__ import annotations

import ast
import json
import re
import sys
import warnings
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extension
from .grammars import GO, JS, TS

#: Fixed: the extensions that claim a language.
CLAIMS = {".py": "python", ".js": "javascript", ".ts": "typescript", ".go": "go", ".json": "json"}


def python_ok(text: str) -> bool:
    """Whether Python's parser takes a text. How many digits a number has is no matter of the grammar."""
    digits = sys.get_int_max_str_digits()
    sys.set_int_max_str_digits(0)
    try:
        return _python_parses(text)
    finally:
        sys.set_int_max_str_digits(digits)


def _python_parses(text: str) -> bool:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text, feature_version=(3, 12))
        except RecursionError:  # the text was parsed; only its tree is too deep to be made into objects
            return True
        except (SyntaxError, ValueError):
            return False
        except MemoryError as e:
            if "too complex to parse" not in str(e):  # memory has run out, which says nothing of the text
                raise
            return False
    return True


def _no_constant(name: str):
    raise ValueError(name)


def json_ok(text: str) -> bool:
    try:
        json.loads(text, parse_constant=_no_constant, parse_int=len, parse_float=len)
    except ValueError:
        return False
    except RecursionError:
        return deep_json_ok(text)
    return True


JSON_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null))', re.A)


def deep_json_ok(text: str) -> bool:
    """Whether a text is JSON, of any depth: open brackets are kept in a list and not on the interpreter's stack."""
    open_: list[str] = []
    want, at = "value", 0  # value, first (value or end), key, first key, colon, rest (comma or end), nothing
    while want != "nothing":
        m = JSON_TOKEN.match(text, at)
        if not m:
            return False
        at, mark = m.end(), m.group(1)
        if want in ("value", "first") and mark in ("{", "["):
            open_.append(mark)
            want = "first key" if mark == "{" else "first"
            continue
        if want == "colon" and mark == ":":
            want = "value"
            continue
        if want in ("key", "first key") and m.group(2):
            want = "colon"
            continue
        if want == "rest" and mark == ",":
            want = "key" if open_[-1] == "{" else "value"
            continue
        if want in ("value", "first") and not mark:
            pass
        elif open_ and (want in ("rest", "first key") and mark == "}" and open_[-1] == "{" or want in ("rest", "first") and mark == "]" and open_[-1] == "["):
            open_.pop()
        else:
            return False
        want = "rest" if open_ else "nothing"
    return not text[at:].strip(" \t\n\r")


PARSERS: dict[str, Callable[[str], bool]] = {"python": python_ok, "javascript": JS, "typescript": TS, "go": GO, "json": json_ok}

#: Tokens that speak for a language, with their weight.
HINTS = {
    "python": re.compile(r"^\s*(?:def|elif|except|with|async def)\b.*:\s*$|^\s*from\s+[\w.]+\s+import\b|\bself\.|\bNone\b", re.M),
    "go": re.compile(r"^package\s+\w+\s*$|^func\b|:=|\bnil\b|^type\s+\w+\s+struct\b", re.M),
    "typescript": re.compile(r"\binterface\s+\w+|:\s*(?:string|number|boolean)\b|\bas\s+\w+|\breadonly\b"),
    "javascript": re.compile(r"\b(?:const|let|var)\s+\w+\s*=|\bfunction\b|=>|===|\bexport\b"),
    "json": re.compile(r'^\s*"[^"]*"\s*:', re.M),
}


def ranked(text: str) -> list[str]:
    """All languages, the likeliest by its tokens first."""
    score = {k: len(v.findall(text)) for k, v in HINTS.items()}
    if text.lstrip()[:1] in ("{", "["):
        score["json"] += 3
    return sorted(PARSERS, key=lambda k: (-score[k], k))


def verdict(language: str, data: bytes | None) -> tuple[str, str | None]:
    """(state, found): state is ok, not-utf8, wrong-extension or corrupt; found the foreign language that parses."""
    try:
        text = (data or b"").decode("utf-8")
    except UnicodeDecodeError:
        return "not-utf8", None
    text = text.removeprefix("﻿")
    if PARSERS[language](text):
        return "ok", None
    if text.strip():
        for other in ranked(text):
            if other != language and PARSERS[other](text):
                return "wrong-extension", other
    return "corrupt", None


def parse_states(files: DataFrame) -> DataFrame:
    """(file_id, repo_id, language, state, parses_as) for the files whose extension claims a supported language.

    ``files`` has file_id, repo_id, relpath, source_bytes. Rows with NULL path or bytes are not files and give no row;
    an empty .json, .go file is invalid, an empty .py, .js, .ts file valid. A byte-order mark at the start is no fault.
    """
    pick = F.create_map(*[F.lit(x) for kv in CLAIMS.items() for x in kv])
    own = files.where("source_bytes is not null and relpath is not null").select("file_id", "repo_id", pick[extension(F.col("relpath"))].alias("language"), "source_bytes").where("language is not null")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for language, data in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                got.append(verdict(language, data))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([g[0] for g in got], type=pa.string()), pa.array([g[1] for g in got], type=pa.string())], names=["file_id", "repo_id", "language", "state", "parses_as"])

    return own.mapInArrow(parse, "file_id long, repo_id int, language string, state string, parses_as string")


def parse_rates(files: DataFrame) -> DataFrame:
    """Per repo_id and language: files, invalid files by kind, and the rate of invalid ones."""
    return parse_states(files).groupBy("repo_id", "language").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("state") == "not-utf8").alias("not_utf8"), F.count_if(F.col("state") == "wrong-extension").alias("wrong_extension"),
        F.count_if(F.col("state") == "corrupt").alias("corrupt"), F.avg((F.col("state") != "ok").cast("double")).alias("rate"),
    )
