"""Scalar functions on columns: paths, hashes, lines, tokens, vectors and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: language names by extension; these extensions are those of source files.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".tsx": "typescript", ".jsx": "javascript", ".go": "go", ".rs": "rust", ".rb": "ruby", ".java": "java", ".kt": "kotlin", ".c": "c", ".cpp": "cpp", ".h": "c", ".hpp": "cpp",
    ".cs": "csharp", ".swift": "swift", ".dart": "dart", ".lua": "lua", ".php": "php", ".sh": "shell", ".bash": "shell", ".zsh": "shell",
}
#: Fixed: ranks of severities.
SEVERITIES = {"low": 1, "medium": 4, "high": 8, "critical": 12}


def lookup(values: dict[str, object], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def tidy(c: Column) -> Column:
    """Lower case without outer white space."""
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def extension(path: Column) -> Column:
    """The lower-cased extension with its dot; '' without one."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def language(path: Column) -> Column:
    """The language of an extension; the bare extension if it is unknown, 'unknown' without one."""
    ext = extension(path)
    return F.coalesce(lookup(LANGUAGES, ext), F.when(ext == "", F.lit("unknown")).otherwise(F.substring(ext, 2, 100)))


def parent(path: Column) -> Column:
    """The folder of a path; '.' at the root."""
    p = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(p == "", F.lit(".")).otherwise(p)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(.)\.[^.]*$", "$1")


def is_test(path: Column) -> Column:
    """Whether a folder of tests is on the path, or the file's name is that of a test."""
    low, name = F.lower(path), F.lower(base_name(path))
    return low.rlike("(^|/)(tests?|__tests__|spec)(/|$)") | name.rlike(r"^test_|\.test|\.spec") | F.lower(stem(path)).rlike("_(test|spec)$")


def is_hidden(path: Column) -> Column:
    """Whether any segment starts with a dot."""
    return path.rlike(r"(^|/)\.[^/]")


def is_generated(path: Column) -> Column:
    """Whether a path has one of six marks of generated files."""
    return path.rlike(r"\.generated\.|\.g\.|\.pb\.|node_modules/|dist/|build/")


def is_source(path: Column) -> Column:
    """Whether the extension is that of a source file."""
    return extension(path).isin(*LANGUAGES)


def ttl_days(path: Column) -> Column:
    """Days until a review is stale: 14 for tests, 7 for production folders, else 21."""
    return F.when(is_test(path), 14).when(path.rlike(r"^(src|lib|app|pkg)/"), 7).otherwise(21)


#: Every line end that str.splitlines knows.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def line_count(text: Column) -> Column:
    """Lines as str.splitlines counts them: a last line end opens no further line."""
    return F.when(text == "", 0).otherwise(F.size(F.split(text, LINE_ENDS, -1)) - F.when(text.rlike(rf"(?:{LINE_ENDS})\z"), 1).otherwise(0))


def py_round(c: Column, digits: int) -> Column:
    """Rounding as Python has it: by the exact binary value, halves to even.

    The product with the power of ten is rounded by Spark's rint; where it lies on a half only because it was rounded
    itself, its error, by a two-product of split halves, decides.
    """
    ten = float(10**digits)
    split = lambda x: x * 134217729.0 - (x * 134217729.0 - x)
    high, p = split(c), c * F.lit(ten)
    th = ten * 134217729.0 - (ten * 134217729.0 - ten)
    low, tl = c - high, ten - th
    error = ((high * th - p) + high * tl + low * th) + low * tl
    half = F.abs(p - F.floor(p)) == 0.5
    whole = F.when(half & (error > 0), F.ceil(p).cast("double")).when(half & (error < 0), F.floor(p).cast("double")).otherwise(F.rint(p))
    return F.when(F.abs(p) < 2.0**52, whole / F.lit(ten)).otherwise(c)


def contains_either(a: Column, b: Column) -> Column:
    """Whether one of two texts holds the other, letter case aside; False if either is empty or NULL."""
    return F.coalesce((F.length(a) > 0) & (F.length(b) > 0) & (F.lower(a).contains(F.lower(b)) | F.lower(b).contains(F.lower(a))), F.lit(False))


def bound_name(dotted: Column) -> Column:
    """The leftmost segment of a dotted name."""
    return F.substring_index(dotted, ".", 1)


def symbol_kind(kind: Column) -> Column:
    """function, class or method; function for anything else."""
    return F.when(kind.isin("function", "class", "method"), kind).otherwise(F.lit("function"))


def scan_id(at: Column, suffix: Column) -> Column:
    """YYYYMMDDTHHMMSSZ-<eight hexadecimal digits>."""
    return F.concat(F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"), F.lit("-"), F.substring(F.lower(suffix), 1, 8))


#: Fixed: manifests and the command that tests what they describe, the first that is there holds.
TEST_COMMANDS = [("package.json", "npm test"), ("pubspec.yaml", "dart test"), ("pyproject.toml", "python -m pytest"), ("setup.py", "python -m pytest"), ("Cargo.toml", "cargo test")]


def test_command(names: Column, makefile: Column) -> Column:
    """The test command of a folder with these file names; a Makefile (its text) counts if it has a target test."""
    found = [F.when(F.array_contains(names, n), F.lit(c)) for n, c in TEST_COMMANDS]
    return F.coalesce(*found, F.when(makefile.rlike(r"(?m)^test\s*:"), F.lit("make test")))


def module_key(path: Column, module: Column, sums: Column) -> Column:
    """The cache key of a Go module: its path and the hashes of its two files (bytes), a missing second one as empty."""
    return F.sha2(F.concat_ws("|", path, F.sha2(module, 256), F.sha2(F.coalesce(sums, F.lit(b"").cast("binary")), 256)), 256)


#: Fixed: words that tell how severe a vulnerability is, the most severe first.
VULNERABLE = [("critical", "critical|remote code|rce|arbitrary code"), ("high", "high|injection|overflow|bypass"), ("medium", "medium|moderate|denial")]


def told_severity(text: Column) -> Column:
    """The severity that a description of a vulnerability tells; low without a telling word."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit("low")
    for level, words in reversed(VULNERABLE):
        out = F.when(low.rlike(words), F.lit(level)).otherwise(out)
    return out


def change_quality(changed: Column, files: Column, passed: Column, failed: Column, checked: Column) -> Column:
    """1 less a quarter at most for changed lines and a fifth for files, a little more or less for tests; 0 to 1."""
    tests = F.when(failed > 0, -0.15).when(passed > 0, 0.05).otherwise(0.0)
    raw = 1.0 - F.least(changed / 400, F.lit(0.25)) - F.least(F.greatest(files - 1, F.lit(0)) * 0.05, F.lit(0.2)) + tests + F.when(checked, 0.03).otherwise(0.0)
    return py_round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 3)


#: Fixed: starts of commands that may be run.
COMMANDS = (("python3", "-m", "pytest"), ("python", "-m", "pytest"), ("pytest",), ("git", "diff"), ("git", "status"), ("git", "log"))


def allowed_command(parts: Column) -> Column:
    """Whether an array of words starts with an allowed command."""
    starts = [F.slice(parts, 1, len(c)) == F.array(*[F.lit(w) for w in c]) for c in COMMANDS]
    out = F.lit(False)
    for s in starts:
        out = out | s
    return F.coalesce(out, F.lit(False))


def inside(path: Column, blocked: tuple[str, ...] = (".git",)) -> Column:
    """Whether a relative path stays within its root once .. is resolved, and has no blocked segment."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.lit(0).alias("least")), lambda s, x: F.struct(
        (s["at"] + F.when(x == "..", -1).otherwise(1)).alias("at"), F.least(s["least"], s["at"] + F.when(x == "..", -1).otherwise(1)).alias("least")))
    return F.coalesce(~path.startswith("/") & (depth["least"] >= 0) & ~F.arrays_overlap(parts, F.array(*[F.lit(b) for b in blocked])), F.lit(False))


def short_hash(c: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(c, 256), 1, n)


def squeeze(c: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def fingerprint(*parts: Column) -> Column:
    """sha256 of the parts joined with |, NULL as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles; 0 where one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    both = norm(a) * norm(b)
    return F.when(both > 0, dot / both).otherwise(0.0)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def impact(callers: Column, symbols: Column) -> Column:
    """log2(1 + callers) / log2(1 + symbols); 0 without callers or symbols."""
    return F.when((symbols > 0) & (callers > 0), F.log2(1 + callers) / F.log2(1 + symbols)).otherwise(0.0)


def truncated(c: Column, n: int) -> Column:
    """A text cut to n characters, with a note of what is left out."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("... ("), (F.length(c) - n).cast("string"), F.lit(" more)"))).otherwise(c)


def glob_to_regex(pattern: Column) -> Column:
    """fnmatch patterns (* crosses /) as anchored regular expressions."""
    quoted = F.regexp_replace(pattern, r"([.+^$(){}|\\])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(quoted, r"\*", ".*"), r"\?", "."), F.lit("$"))
