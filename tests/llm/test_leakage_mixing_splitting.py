import random

import pytest

from quern.llm import leakage, mixing, splitting

DOCS = "doc_id long, text string, mark long, id string"
ITEMS = "item_id long, field string, text string"


def words(seed, n):
    r = random.Random(seed)
    return [r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(n)]


def test_leaks_equal_brute_force(spark):
    r = random.Random(3)
    items = [(i, "question", " ".join(words(i, r.randint(5, 40)))) for i in range(12)]
    docs = []
    for k in range(40):
        w = words(1000 + k, r.randint(0, 60))
        if k % 2:
            src = r.choice(items)[2].split()
            a, n = r.randint(0, max(0, len(src) - 6)), r.choice([8, 11, 12, 13, 30])
            w = [*w, *[x.upper() if r.random() < 0.3 else x + "," for x in src[a : a + n]], *words(k, 5)]
        docs.append((k, " ".join(w), 1, "clash"))

    def shares(d, t):
        d, t = (leakage.WORD.findall(x.lower()) for x in (d, t))
        grams = {tuple(t[i : i + 12]) for i in range(len(t) - 11)}
        return any(tuple(d[i : i + 12]) in grams for i in range(len(d) - 11))

    want = {(k, i) for k, d, *_ in docs for i, _, t in items if shares(d, t)}
    for send in (0, 10**6):
        got = [(x.doc_id, x.item_id) for x in leakage.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), send=send).collect()]
        assert set(got) == want and len(got) == len(want)


def test_leaks_edges(spark):
    t = " ".join(f"w{i}" for i in range(12))
    docs = [(1, None, 1, ""), (2, "", 1, ""), (3, "x " * 50000 + t, 1, ""), (3, "x " * 50000 + t, 1, ""), (None, t, 1, ""), (4, " ".join(t.split()[:11]), 1, "")]
    items = [(1, "question", t), (1, "question", t), (2, "answer", None), (3, "answer", ""), (None, "answer", t)]
    got = leakage.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert [(x.doc_id, x.item_id, x.words) for x in got] == [(3, 1, 12)]
    none = spark.createDataFrame([], DOCS)
    assert leakage.leaks(none, spark.createDataFrame(items, ITEMS)).collect() == []
    assert leakage.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], ITEMS)).collect() == []


SIZED = "doc_id long, source string, size long, key string"
TARGETS = "source string, target_share double, max_repeats int, size int"


def test_mix_shares_and_order(spark):
    r = random.Random(1)
    rows = [(i, r.choice(["A", " a", "a "]), r.randint(1, 90), "") for i in range(600)] + [(1000 + i, "b", r.randint(1, 90), "") for i in range(300)] + [(2000 + i, "C", r.randint(1, 90), "") for i in range(40)]
    targets = [("a", 0.5, 2, 1), ("B", 0.4, 3, 1), ("c", 0.1, 1, 1)]
    s, t = spark.createDataFrame(rows, SIZED), spark.createDataFrame(targets, TARGETS)
    got = {x.source: x for x in mixing.shares(s, t).collect()}
    size = {k: sum(x[2] for x in rows if x[1].strip().lower() == k) for k in "abc"}
    total = sum(size.values())
    assert got["c"].short == (size["c"] < 0.1 * total) and not got["a"].short
    for k, w, n in (("a", 0.5, 2), ("B", 0.4, 3), ("c", 0.1, 1)):
        want = min(w * total, n * size[k.lower()])
        assert want <= got[k].units <= want + 90
        assert got[k].passes <= n
    block = 500
    mixed = mixing.mix(s, t, block).collect()
    want = {k: min(w * total, n * size[k.lower()]) for k, w, n in (("a", 0.5, 2), ("B", 0.4, 3), ("c", 0.1, 1))}
    blocks = {k: -int(-v // block) for k, v in want.items()}
    order = dict(sorted({x.slot: x.source for x in mixed}.items()))
    assert len({(x.slot, x.source) for x in mixed}) == len(order) == sum(blocks.values())  # one source a slot, all slots taken
    assert list(order) == list(range(len(order)))
    near_even(list(order.values()), blocks)
    units = {}
    for x in mixed:
        units[x.slot] = units.get(x.slot, 0) + x.units
    assert all(u <= block + 90 for u in units.values())


def near_even(order, slots):
    """Every prefix has each source's share but for less than one block."""
    q, seen = sum(slots.values()), dict.fromkeys(slots, 0)
    assert len(order) == q
    for t, k in enumerate(order, 1):
        seen[k] += 1
        assert all(abs(seen[x] * q - t * n) < q for x, n in slots.items())


@pytest.mark.parametrize("seed", range(12))
def test_period_deviates_by_less_than_one_block(seed):
    r = random.Random(seed)
    slots = {f"s{i}": r.choice([1, 2, 3, 50, 400]) * r.randint(1, 9) for i in range(r.randint(1, 20))}
    near_even(mixing.period(slots), slots)


def test_period_of_a_half_and_five_tenths():
    near_even(mixing.period({"a": 5, **{f"b{i}": 1 for i in range(5)}}), {"a": 5, **{f"b{i}": 1 for i in range(5)}})


def test_quantised_weights_fill_the_period():
    for blocks in ({"a": 10**9, "b": 1, "c": 3 * 10**8}, {f"s{i}": i * i for i in range(200)}, {"a": 3, "b": 0}):
        got = mixing.quantised(blocks, 1000)
        every = sum(blocks.values())
        assert sum(got.values()) == min(1000, every) and set(got) == {k for k, n in blocks.items() if n}
        if every > 1000 and len(blocks) < 10:
            assert all(abs(n / every - got[k] / 1000) <= 2 / 1000 for k, n in blocks.items())


def test_periods_repeat_when_blocks_exceed_one(spark):
    rows = [(i, "a" if i % 3 else "b", 10, "") for i in range(3000)]
    got = mixing.schedule(spark.createDataFrame(rows, SIZED), spark.createDataFrame([("a", 0.6, 1, 1), ("b", 0.3, 1, 1)], TARGETS), block=10, most=30).collect()
    order = [x.source for x in sorted(got, key=lambda x: x.slot)]
    assert order[:30] == order[30:60] and len({x.slot for x in got}) == len(got) == 2700
    near_even(order[:30], {"a": 20, "b": 10})


def test_mix_edges(spark):
    t = spark.createDataFrame([("a", 0.5, 1, 1), ("gone", 0.5, 4, 1), (None, 0.1, 1, 1), ("n", None, None, 1)], TARGETS)
    rows = spark.createDataFrame([(1, "a", 10, ""), (2, None, 10, ""), (3, "a", None, ""), (4, "other", 10, ""), (5, "a", 0, "")], SIZED)
    got = {x.source: x for x in mixing.plan(rows, t).collect()}
    assert got["a"].size == 10 and got["a"].total == 20 and not got["a"].short
    assert got["gone"].size == 0 and got["gone"].short and not got["n"].short
    none = spark.createDataFrame([], SIZED)
    assert all(x.weight == 0 for x in mixing.plan(none, t).collect())
    assert mixing.mix(none, t).collect() == []
    assert {x.source for x in mixing.shares(rows, t).collect() if x.short} == {"gone"}
    assert not any(x.short for x in mixing.shares(none, t).collect())


def test_mix_of_repeated_and_nameless_documents(spark):
    rows = [(None, "a", 7, ""), (None, "a", 7, ""), (1, "a", 5, ""), (1, "a", 5, ""), (1, "a", 9, ""), (2, "B", 40, ""), (3, None, 5, "")]
    t = spark.createDataFrame([("a", 0.5, 2, 1), ("b", 0.5, 1, 1)], TARGETS)
    got = mixing.mix(spark.createDataFrame(rows, SIZED), t, block=10).collect()
    for k in ("a", "b"):
        spans = sorted((x.start, x.start + x.units) for x in got if x.source == k)
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))  # uses follow each other without a gap
    assert {(x.doc_id, x.pass_no) for x in got if x.source == "a"} >= {(None, 1), (1, 1)} and sum(x.source == "b" for x in got) == 1


def test_words_are_split_at_any_white_space(spark):
    text = "a\tb c d  e\x1cf\n"
    assert spark.createDataFrame([(text,)], "t string").select(mixing.word_count("t")).first()[0] == len(text.split())


def check(lines, limit, overlap, got):
    covered = set()
    for first, last, text in got:
        assert len(text) <= limit
        if first != last or text == lines[first - 1]:
            assert text == "\n".join(lines[first - 1 : last])
        covered |= set(range(first, last + 1))
    assert covered == set(range(1, len(lines) + 1))


@pytest.mark.parametrize("seed", range(30))
def test_pieces_cover_within_limit(seed):
    r = random.Random(seed)
    lines = ["    " * r.randint(0, 3) + "x" * r.choice([0, 3, 20, 60, 60, 200]) for _ in range(r.randint(1, 80))]
    limit, overlap = r.choice([50, 150, 400]), r.choice([0, 2, 5])
    check(lines, limit, overlap, splitting.pieces(lines, limit, overlap, r.random() < 0.5))


def test_pieces_cut_between_definitions_and_overlap():
    lines = []
    for i in range(20):
        lines += [f"def f{i}(a):", "    b = a + 1", "    if b:", "        return b", "    return a", ""]
    got = splitting.pieces(lines, 400, 2)
    check(lines, 400, 2, got)
    assert len(got) > 3
    for (_, last, _), (first, _, _) in zip(got, got[1:], strict=False):
        assert first == last - 1  # two shared lines
        assert lines[last].startswith("def") or lines[last] == ""  # what is new starts with a definition


def test_nodes_that_fit_are_not_cut():
    sizes = (41, 104, 104)
    lines = []
    for i, n in enumerate(sizes):
        body = ["    " + "x" * 10] * 2
        lines += [f"def f{i}(" + "a" * (n - 9 - sum(len(x) + 1 for x in body)) + "):", *body]
    ends = [3, 6, 9]
    assert [sum(len(x) + 1 for x in lines[e - 3 : e]) - 1 for e in ends] == list(sizes)
    assert [(a, b) for a, b, _ in splitting.pieces(lines, 110, 0)] == [(1, 3), (4, 6), (7, 9)]


def test_sections_of_unlike_parents_stay_apart():
    text = ["# A", "aa " * 20, "## A1", "bb " * 20, "## A2", "cc", "# B", "dd", "## B1", "ee " * 20, "## B2", "ff " * 20]
    got = splitting.pieces(text, 150, 0, True)
    check(text, 150, 0, got)
    starts = [text[a - 1] for a, _, _ in got]
    assert all(x.startswith("#") for x in starts) and "# B" in starts


def test_nested_heads_and_ends_go_with_what_they_hold():
    deep = 40
    lines = [" " * i + f"k{i}: {{" for i in range(deep)] + [" " * deep + "x" * 30] * 20 + [" " * i + "}" for i in range(deep - 1, -1, -1)]
    got = splitting.pieces(lines, 400, 1)
    check(lines, 400, 1, got)
    assert len(got) <= 3 * sum(len(x) + 1 for x in lines) // 400


def test_split_edges(spark):
    files = [(1, "a/b.PY", ["x" * 30]), (2, "a.py", None), (3, None, ["x" * 99]), (4, "a.zz", ["x" * 99]), (5, "a.py", []), (6, "a.py", ["ä" * 10, None]), (7, "a.py", ["é" * 5] * 3)]
    t = spark.createDataFrame([(*f, "clash") for f in files], "file_id long, relpath string, lines array<string>, text string")
    limits = spark.createDataFrame([(".py", "python", 11, 1), (".py", None, 12, 9), (None, None, 1, 1)], "extension string, language string, max_chars int, overlap_lines int")
    got = splitting.split(t, limits).collect()
    assert {x.file_id for x in got} == {1, 7}
    assert all(x.chars <= 11 for x in got) and "".join(x.text for x in got if x.file_id == 1) == "x" * 30
    assert splitting.split(t.limit(0), limits).collect() == [] and splitting.split(t, limits.limit(0)).collect() == []
