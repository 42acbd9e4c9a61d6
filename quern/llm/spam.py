"""Problem 9: pages of repeated keywords, links or tags, told by the shapes of their lines.

Each line is reduced to a shape: buckets of its number of words and of function words among them, how its words are
capitalised and repeated, its separators, links and tags, and how it ends. The shape alone decides what a line is: a
sentence, or links, tags, keywords or a title. Logs, tables and code are taken for sentences, as are lists of them. A
page is flagged if lines of non-sentence shapes hold more than half of its words and few shapes hold most of these.

What is no sentence has hardly any of the words that sentences need in the languages at hand, and has instead
separators after every few words or the same words over and over. ``crawl_shapes`` groups the lines of a whole crawl.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed: common function words of English, German, Spanish and French.
FUNCTION_WORDS = frozenset(
    (
        "the a an and or but of to in on at by with from that this these those is are was were be been has have had not no it its as if when while which who what we our they their he she i will would can could should may must do does did so than then there after before until without under over into about because one also only just still now "
        "der die das den dem des ein eine einer eines einem einen und oder aber von zu zum zur im in an auf mit aus bei nach vor ist sind war waren wird werden wurde hat haben hatte nicht kein keine es sie er wir als wenn weil dass sich auch nur noch für über unter durch bis um ohne "
        "el la los las un una unos unas y o pero de del al en con por para sin sobre que se su sus es son era fue ser ha han no lo le les como más cuando porque si ya muy este esta estos estas "
        "le la les un une des du de et ou mais à au aux en dans avec par pour sans sur que qui se son sa ses est sont était été être a ont ne pas il elle on nous ce cette ces comme plus quand parce si très"
    ).split()
)
LINK = re.compile(r"!?\[([^\]]*)\]\(\s*[^)\s]*[^)]*\)|<a\b[^>]*>(.*?)</a>|(?:https?://|www\.)[^\s<>|]+", re.I | re.S)
MARKUP = re.compile(r"</?[a-zA-Z][^>]*>")
TAG = re.compile(r"(?<!\S)#[^\W\d_][\w-]*")
TITLE = re.compile(r"\s(?:-|–|—|>>|>|»|\||::|·|/)\s+(?:www\.)?(?:[\w-]+\.)+[a-z]{2,}/?$")
SEPARATOR = re.compile(r"[,;|·•»/]|>>|\s[-–—:]\s")
WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
LOG = re.compile(r"^\W*(?:\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\d\d:\d\d:\d\d|\[?(?:DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|TRACE)\b)")
TABLE = re.compile(r"^\s*\|.*\|\s*$")
CODE = re.compile(r"^(?: {4}|\t)|[{};]\s*$|^\s*(?:def|class|return|import|from|func|function|const|let|var|if|for|while|package|type)\b.*[:({;=]|^\s*[\w.]+\([^)]*\)\s*;?$|^\s*[\w.]+\s*:?=\s*\S")
SHARE = 0.5


class Shape(NamedTuple):
    """What is left of a line: everything that decides what kind of line it is."""

    words: int  # own words besides links and tags: 0 under 4, 1 up to 5, 2 for 6, 3 up to 9, 4 up to 12, 5 beyond
    bound: int  # function words: 0 none, 1 under one in eight, 2 up to one in four, 3 more
    capitals: str  # u all words, m most of several, l else
    separated: bool  # a separator after every five words or more often
    repeated: bool  # a third of the words or more repeat others
    links: int  # 0 none, 1 one or two, 2 more
    linked: bool  # more words in links than beside them
    tags: int  # 0 none, 1 one, 2 more
    site: bool  # ends in the name of a site
    end: str  # . ! ? : or nothing


@cache
def kind_of(x: Shape) -> str:
    """The kind of a shape; ``text`` is what may be a sentence."""
    flat = x.words == 0 or x.bound <= 1 and (x.separated or x.words >= 4 and x.repeated)
    if x.site and x.words <= 4 and x.bound <= 2:
        return "title"
    if x.links and (flat or x.bound == 0 and x.words <= 2):
        return "links"
    if x.tags == 2 and flat:
        return "tags"
    if x.words >= 2 and flat:
        return "keywords"
    if x.links == 2 and x.linked:
        return "linked text"
    return "text"


def shape(line: str) -> tuple[Shape, int, int]:
    """(shape, blank-separated words, those of them in links) of a line."""
    total = len(line.split())
    links = [0, 0]

    def drop(m: re.Match) -> str:
        links[0] += 1
        links[1] += len(m.group(0).split())
        return " "

    rest = LINK.sub(drop, line)
    if "<" in rest:
        rest = MARKUP.sub(" ", rest)
    tags = len(TAG.findall(rest))
    if tags:
        rest = TAG.sub(" ", rest)
    body = WORD.findall(rest)
    n = len(body)
    low = [w.lower() for w in body]
    stops = sum(w in FUNCTION_WORDS for w in low)
    caps = sum(w[0].isupper() for w in body)
    end = line.rstrip()[-1:]
    return Shape(
        0 if n < 4 else 1 if n < 6 else 2 if n == 6 else 3 if n < 10 else 4 if n <= 12 else 5, 0 if not stops else 1 if stops * 8 < n else 2 if stops * 4 <= n else 3, "u" if n and caps == n else "m" if caps > 1 and caps * 2 > n else "l",
        len(SEPARATOR.findall(rest)) * 5 >= n, len(set(low)) * 3 <= n * 2, min((links[0] + 2) // 3 if links[0] < 3 else 2, 2), links[1] > total - links[1] - tags, min(tags, 2), bool(TITLE.search(line)), end if end in ".!?:" else "",
    ), total, links[1]


def lines(text: str) -> Iterator[tuple[Shape | None, int, int]]:
    """``shape`` of each line with words; logs, tables, code and what is fenced as such have none."""
    fence = False
    for line in text.replace("\r", "\n").split("\n"):
        n = len(line.split())
        if line.lstrip().startswith(("```", "~~~")):
            fence = not fence
            yield None, n, 0
        elif fence or CODE.search(line) and not LINK.search(line) and line.count(";") < 3 or LOG.match(line) or TABLE.match(line):
            yield None, n, 0
        elif n:
            yield shape(line)


def page(text: str) -> tuple[int, int, int, float, str | None]:
    """(words, words of non-sentence shapes, number of these shapes, share of their eight commonest, main kind)."""
    words = bad = 0
    shapes: Counter[Shape] = Counter()
    kinds: Counter[str] = Counter()
    for x, n, linked in lines(text):
        words += n
        kind = kind_of(x) if x else "text"
        if kind != "text":
            b = linked if kind == "linked text" else n
            bad += b
            shapes[x] += b
            kinds[kind.split()[0] if kind != "linked text" else "links"] += b
    few = sum(v for _, v in shapes.most_common(8)) / bad if bad else 0.0
    return words, bad, len(shapes), few, kinds.most_common(1)[0][0] if kinds else None


def page_shapes(documents: DataFrame) -> DataFrame:
    """(doc_id, words, bad_words, shapes, few, kind) for documents with text; NULL text gives no row, empty one 0 words."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*map(page, batch.column(1).to_pylist()), strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "words", "bad_words", "shapes", "few", "kind"])

    return documents.where("text is not null").select("doc_id", "text").mapInArrow(reduce, "doc_id long, words long, bad_words long, shapes int, few double, kind string")


def flagged(documents: DataFrame, share: float = SHARE, few: float = 0.5) -> DataFrame:
    """The rows of ``page_shapes`` whose words are mostly in few non-sentence shapes."""
    return page_shapes(documents).where((F.col("bad_words") > F.col("words") * share) & (F.col("few") >= few))


def crawl_shapes(documents: DataFrame) -> DataFrame:
    """(shape, kind, lines, words, pages) of all lines of a crawl, grouped by shape; a shape is written as its fields.

    Lines are counted per batch before they are sent, so that what is sent follows the number of shapes.
    """

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, words, pages = Counter(), Counter(), Counter()
            for text in batch.column(0).to_pylist():
                seen = set()
                for x, k, _ in lines(text):
                    if x:
                        n[x] += 1
                        words[x] += k
                        seen.add(x)
                pages.update(seen)
            every = list(n)
            cols = [["/".join(str(int(v) if isinstance(v, bool) else v) for v in x) for x in every], [kind_of(x) for x in every], *([c[x] for x in every] for c in (n, words, pages))]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)], names=["shape", "kind", "lines", "words", "pages"])

    own = documents.where("text is not null").select("text").mapInArrow(reduce, "shape string, kind string, lines long, words long, pages long")
    return own.groupBy("shape", "kind").agg(F.sum("lines").alias("lines"), F.sum("words").alias("words"), F.sum("pages").alias("pages"))
