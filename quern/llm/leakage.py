"""Problem 7: passages of held-out items inside a corpus, by winnowing.

A text's fingerprints are the hashes of its word k-grams that are least in some window of w successive ones. With
k + w - 1 <= SPAN, a span of SPAN words that two texts share has a whole window in common and so a fingerprint: no
shared span of that length is missed. Fingerprints of corpus and items are joined, and every document and item that
have one in common are compared word by word (hits are extended to the whole shared span).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, signed

WORD = re.compile(r"[a-z0-9]+")
SPAN = 12
GRAM = 6
#: Test fingerprints (16 bytes each) and the characters of the items are sent to all executors up to these numbers;
#: beyond either of them both joins shuffle.
SEND, SEND_CHARS = 1_000_000, 16_000_000


class Winnower:
    def __init__(self, gram: int, window: int, room: int = 1 << 20):
        self.gram, self.window, self.room, self.known = gram, window, room, {}

    def __call__(self, text: str) -> np.ndarray:
        """The distinct fingerprints of a text; fewer words than gram + window - 1 hold no span of that length."""
        words = WORD.findall(text.lower())
        if len(words) < self.gram + self.window - 1:
            return np.zeros(0, dtype=np.uint64)
        known, ids = self.known, []
        for w in words:
            h = known.get(w)
            if h is None:
                h = xxhash.xxh64_intdigest(w)
                if len(known) < self.room:
                    known[w] = h
            ids.append(h)
        h = np.array(ids, dtype=np.uint64)
        n = len(h) - self.gram + 1
        with np.errstate(over="ignore"):
            g = np.zeros(n, dtype=np.uint64)
            for i in range(self.gram):
                g = g * np.uint64(0x100000001B3) + h[i : i + n]
        g = mix(g, 29)
        return np.unique(np.lib.stride_tricks.sliding_window_view(g, self.window).min(axis=1))


def fingerprints(rows: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Rows (id, text) to distinct (id, mark)."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        winnow = Winnower(gram, span - gram + 1)
        for batch in batches:
            found = [winnow(t) if t else np.zeros(0, dtype=np.uint64) for t in batch.column(1).to_pylist()]
            sizes = [len(x) for x in found]
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array(signed(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64))], names=["id", "mark"])

    return rows.select("id", "text").where("id is not null").mapInArrow(marks, "id long, mark long")


def longest_shared(a: list[str], b: list[str]) -> int:
    """Words of the longest span that two texts share, extended from shared words."""
    where: dict[str, list[int]] = {}
    for j, w in enumerate(b):
        where.setdefault(w, []).append(j)
    best, row = 0, {}
    for w in a:
        new = {}
        for j in where.get(w, ()):
            new[j] = row.get(j - 1, 0) + 1
            if new[j] > best:
                best = new[j]
        row = new
    return best


class Items:
    """Fingerprints and words of held-out fields, small enough to be sent."""

    def __init__(self, marks: np.ndarray, fields: np.ndarray, words: list[list[str]], span: int, gram: int):
        order = np.argsort(marks, kind="stable")
        self.marks, self.fields, self.words = marks[order], fields[order], words
        self.span, self.winnow = span, Winnower(gram, span - gram + 1)

    def hits(self, text: str) -> list[tuple[int, int]]:
        """(field, words of the longest shared span) of the fields that share a fingerprint and a span with the text."""
        own = signed(self.winnow(text))
        at = np.searchsorted(self.marks, own)
        own = own[(at < len(self.marks)) & (self.marks[np.minimum(at, len(self.marks) - 1)] == own)] if len(self.marks) else own[:0]
        if not len(own):
            return []
        lo, hi = np.searchsorted(self.marks, own), np.searchsorted(self.marks, own, side="right")
        words = WORD.findall(text.lower())
        found = [(int(f), longest_shared(words, self.words[f])) for f in np.unique(np.concatenate([self.fields[i:j] for i, j in zip(lo, hi, strict=True)]))]
        return [(f, n) for f, n in found if n >= self.span]


def leaks(documents: DataFrame, items: DataFrame, span: int = SPAN, send: int = SEND) -> DataFrame:
    """(doc_id, item_id, field, words): fields of items of which a document has at least ``span`` words in a row.

    ``documents`` has doc_id, text; ``items`` item_id, field, text. NULL and short texts share nothing; repeated rows
    of one id count once; an empty table gives an empty result. words is the longest shared span.

    Up to ``send`` test fingerprints the corpus is read once and not shuffled: fingerprints are joined and hits extended
    where the document is. Beyond it both sides of the join are shuffled by fingerprint and the hits by document.
    """
    fields = items.where("item_id is not null and text is not null").select("item_id", "field", "text").distinct()
    keyed = fields.select(F.xxhash64("item_id", "field", "text").alias("id"), "item_id", "field", "text")
    docs = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("id"), "text")
    test = fingerprints(keyed, span)
    size = test.count()
    if size <= send and (keyed.agg(F.sum(F.length("text"))).first()[0] or 0) <= SEND_CHARS:
        found = _sent(docs, keyed, test, span)
    else:
        found = _shuffled(docs, keyed, test, span)
    return found.groupBy("doc_id", "item_id", "field").agg(F.max("words").alias("words"))


def _sent(docs: DataFrame, keyed: DataFrame, test: DataFrame, span: int) -> DataFrame:
    own = keyed.toArrow()
    place = {k: i for i, k in enumerate(own.column("id").to_pylist())}
    marks = test.toArrow()
    sent = docs.sparkSession.sparkContext.broadcast((
        marks.column("mark").to_numpy(), np.array([place[k] for k in marks.column("id").to_pylist()], dtype=np.int64),
        [WORD.findall(t.lower()) for t in own.column("text").to_pylist()], own.column("item_id").to_numpy(), own.column("field").to_pylist(),
    ))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, fields, words, ids, names = sent.value
        known = Items(marks, fields, words, span, GRAM)
        for batch in batches:
            rows = [(d, f, n) for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for f, n in known.hits(text)]
            cols = [[d for d, _, _ in rows], [ids[f] for _, f, _ in rows], [names[f] for _, f, _ in rows], [n for _, _, n in rows]]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int32()), strict=True)], names=["doc_id", "item_id", "field", "words"])

    return docs.mapInArrow(look, "doc_id long, item_id long, field string, words int")


def _shuffled(docs: DataFrame, keyed: DataFrame, test: DataFrame, span: int) -> DataFrame:
    hits = fingerprints(docs, span).join(test.withColumnRenamed("id", "field_id").hint("merge"), "mark").select("id", "field_id").distinct()
    texts = keyed.select(F.col("id").alias("field_id"), "item_id", "field", F.col("text").alias("item_text"))
    pairs = hits.join(texts.hint("merge"), "field_id").join(docs.hint("merge"), "id").select("id", "item_id", "field", "item_text", "text")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [longest_shared(WORD.findall(t.lower()), WORD.findall(i.lower())) for i, t in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, type=pa.int32())], names=["doc_id", "item_id", "field", "words"])

    return pairs.mapInArrow(extend, "doc_id long, item_id long, field string, words int").where(F.col("words") >= span)


def item_fields(items: DataFrame) -> DataFrame:
    """Questions and answers as rows of their own."""
    return items.select("item_id", F.explode(F.array(F.struct(F.lit("question").alias("field"), F.col("question").alias("text")), F.struct(F.lit("answer").alias("field"), F.col("answer").alias("text")))).alias("f")).select("item_id", "f.field", "f.text")
