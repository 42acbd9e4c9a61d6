"""Problem 2: cut files over a size limit at natural boundaries, by packing a tree of their structure.

The tree follows from headings and indentation: a line holds the more deeply indented lines after it, a heading of
rank r holds what follows it up to the next heading of its rank. Sibling subtrees are merged into a piece as long as it
is within the limit; only a subtree that is over the limit is descended into, and only a line that is over the limit by
itself is cut within (at a blank where it has one). Consecutive pieces share the stated number of whole lines, or as
many of them as leave room for one more line; what is shared counts towards the limit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extension

HEADING = re.compile(r"(#{1,6})\s+\S")
SECTION = re.compile(r"\[[^\]]+\]\s*$")


def levels(lines: list[str], marked: bool) -> list[int]:
    """The depth of each line: columns of indentation, blank lines with what follows, closing lines with their block.

    With ``marked`` headings (# ..., [section]) open a level that holds the lines up to the next such heading.
    """
    out, under = [0] * len(lines), 0
    for i, line in enumerate(lines):
        body = line.lstrip()
        if not body.strip():
            out[i] = -1
            continue
        base = len(line[: len(line) - len(body)].expandtabs(4))
        if marked and base == 0:
            m = HEADING.match(line)
            if m or SECTION.match(line):
                rank = len(m.group(1)) if m else 1
                out[i], under = rank, rank
                continue
        closing = body[0] in ")]}" or body.rstrip() in ("end", "fi", "done", "esac")
        out[i] = under + 1 + base + (1 if closing else 0)
    after = max(out, default=0) if out else 0
    for i in range(len(out) - 1, -1, -1):
        if out[i] < 0:
            out[i] = after
        after = out[i]
    return out


def shares_end(line: str) -> bool:
    """Whether a line only closes what is open."""
    return line.strip()[:1] in (")", "]", "}") or line.strip() in ("end", "fi", "done", "esac")


def groups(lines: list[str], limit: int, overlap: int, marked: bool) -> list[tuple[int, int]]:
    """The first and past-the-last line that each piece adds, by packing the tree's siblings.

    A node is taken whole if it is within the limit together with the lines it shares with the piece before. Siblings
    are merged as long as that holds; nodes of unlike parents are not, but for heads, which go with what follows them,
    and closing lines, which go with what they close. Only a node over the limit is descended into.
    """
    depth = levels(lines, marked)
    size = [0]
    for line in lines:
        size.append(size[-1] + len(line) + 1)

    def fits(a: int, b: int) -> bool:
        return size[b] - size[max(0, a - overlap)] - 1 <= limit

    out: list[tuple[int, int]] = []
    open_: tuple[int, int, int] | None = None  # lines of the piece at hand and the node whose children they are
    heads = False  # whether these are heads alone
    todo, nodes = [(0, len(lines), 0)], 0
    while todo:
        a, b, parent = todo.pop()
        if open_ and (open_[2] == parent or b - a == 1 and shares_end(lines[a])) and fits(open_[0], b):
            open_ = (open_[0], b, open_[2])
            heads = heads and b - a == 1 and bool(todo) and todo[-1][2] == parent and depth[todo[-1][0]] > depth[a]
            continue
        if b - a == 1 or fits(a, b):
            if open_:
                out.append(open_[:2])
            open_, heads = (a, b, parent), b - a == 1
            continue
        nodes += 1
        if heads and open_:
            open_ = (*open_[:2], nodes)
        least = min(depth[a:b])
        starts = [i for i in range(a, b) if depth[i] == least]
        if starts[0] != a:
            starts.insert(0, a)
        if len(starts) == 1:  # a head and what it holds
            todo += [(a + 1, b, nodes), (a, a + 1, nodes)]
        else:
            todo += [(x, y, nodes) for x, y in zip(starts, [*starts[1:], b], strict=True)][::-1]
    if open_:
        out.append(open_[:2])
    return out


def pieces(lines: list[str], limit: int, overlap: int, marked: bool = False) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of each piece, lines 1-based; every text has at most ``limit`` characters."""
    limit, overlap = max(1, limit), max(0, overlap)
    out: list[tuple[int, int, str]] = []
    whole = 0  # lines before this one are not shared: a line was cut within
    for a, b in groups(lines, limit, overlap, marked):
        if b - a == 1 and len(lines[a]) > limit:
            rest = lines[a]
            while len(rest) > limit:
                at = rest.rfind(" ", limit // 2, limit) + 1 or limit
                out.append((a + 1, a + 1, rest[:at]))
                rest = rest[at:]
            if rest:
                out.append((a + 1, a + 1, rest))
            whole = b
            continue
        first = max(whole, a - overlap)
        text = "\n".join(lines[first:b])
        while first < a and len(text) > limit:  # a line that leaves no room for all that is to be shared
            text = text[len(lines[first]) + 1 :]
            first += 1
        out.append((first + 1, b, text))
    return out


def split(files: DataFrame, limits: DataFrame) -> DataFrame:
    """(file_id, relpath, piece_no, n_pieces, first_line, last_line, chars, text) of the files over their limit.

    ``files`` has file_id, relpath, lines; ``limits`` extension, max_chars, overlap_lines. A file is over the limit if
    its lines joined with a line feed have more characters (code points). Files with NULL lines or path, without a
    limit for their extension, or within it, give no rows; NULL lines within a file count as empty. Should an extension
    have several limits the smallest holds.
    """
    few = limits.where("extension is not null and max_chars is not null").groupBy(F.lower("extension").alias("ext")).agg(F.min(F.struct("max_chars", F.coalesce("overlap_lines", F.lit(0)).alias("overlap_lines"))).alias("l")).select("ext", "l.*")
    own = files.where("lines is not null and relpath is not null").select("file_id", "relpath", "lines", extension(F.col("relpath")).alias("ext"))
    chars = F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + F.coalesce(F.length(x), F.lit(0)) + 1) - 1
    over = own.join(few, "ext").where(chars > F.col("max_chars")).select("file_id", "relpath", "ext", "lines", "max_chars", "overlap_lines")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file_id", "relpath", "piece_no", "n_pieces", "first_line", "last_line", "chars", "text"]
        for batch in batches:
            rows = []
            for f, path, ext, lines, most, overlap in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got = pieces([x or "" for x in lines], most, overlap, ext in (".md", ".rst", ".txt", ".ini", ".toml", ".cfg"))
                rows += [(f, path, k + 1, len(got), a, b, len(t), t) for k, (a, b, t) in enumerate(got)]
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return over.mapInArrow(cut, "file_id long, relpath string, piece_no int, n_pieces int, first_line int, last_line int, chars long, text string")
