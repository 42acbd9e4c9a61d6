import pytest

from quern.llm import spam

PROSE = "The scanner skips the queue before the lock returns, so three rows stay in the digest. Please split the function into two and keep the cache next to the reader."


@pytest.mark.parametrize(
    "text, want",
    [
        ("cheap linter · best linter · " * 40, True), ("\n".join("#tag%d #linter" % i for i in range(30)), True), ("\n".join(f"* [best lock {i}](https://x{i}.test/a)" for i in range(20)), True), ("\n".join(f"Best Linter - site{i}.test" for i in range(20)), True), (PROSE, False),
        ("Keywords: " + ", ".join(["triage bot", "bug finder", "auto fix"] * 20), True), ("triage bot auto fix probe leaf table " * 20, True), (PROSE * 3 + "\nReferences\n" + "\n".join(f"- [old lock {i}](https://x.test/{i})" for i in range(4)), False),
        ("\n".join(f"- The lock {i} is held by the reader and has to be released first." for i in range(20)), False), ("\n".join(f"2025-03-23T23:56:{i:02}Z WARN gate_closed path=a/b.py took=401ms" for i in range(40)), False), ("| a | b |\n|---|---|\n" + "| x | 1 |\n" * 40, False),
        ("```\n" + "def f(a):\n    return a\n" * 20 + "```", False), ("", False), (" \n\n", False), ("\n".join(f"[{PROSE[:30]}](https://x.test/{i}): {PROSE}" for i in range(9)), False), (PROSE + "\n" + "buy linter, " * 60, True), (PROSE * 4 + "\n" + "buy linter, " * 20, False),
    ],
)
def test_pages(text, want):
    words, bad, _, few, _ = spam.page(text)
    assert (bad > words * spam.SHARE and few >= 0.5) == want
    assert words == len(text.split())


def test_tables(spark):
    schema = "doc_id long, text string, words long, kind string"
    rows = [(1, "cheap linter, " * 50, 1, "x"), (1, "cheap linter, " * 50, 1, "x"), (2, None, 1, "x"), (3, "", 1, "x"), (4, PROSE * 3000, 1, "x"), (None, "#a #b #c #d", 1, "x")]
    got = [x.doc_id for x in spam.flagged(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(got, key=str) == [1, 1, None]
    assert spam.flagged(spark.createDataFrame([], schema)).collect() == []


def test_shapes_alone_decide_and_group(spark):
    texts = [PROSE, "cheap linter, " * 30, "#a #b #c #d", "cheap linter, " * 30 + "\n" + PROSE, "", None, "| a | b |"]
    got = spam.crawl_shapes(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, shape string")).collect()
    every = [(x, n) for t in texts if t for x, n, _ in spam.lines(t) if x]
    assert sum(x.lines for x in got) == len(every) and sum(x.words for x in got) == sum(n for _, n in every)
    assert {x.kind: x.pages for x in got} == {"text": 2, "keywords": 2, "tags": 1}
    assert len({spam.kind_of(x) for x, _ in every}) == 3
    assert spam.crawl_shapes(spark.createDataFrame([], "text string")).collect() == []
