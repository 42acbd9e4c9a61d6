import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import history, near_duplicates as nd, signatures

SCHEMA = "id long, grp string, text string"


def tokens(t):
    return frozenset(re.findall(r"[a-z0-9_]+", (t or "").lower()))


def similar(a, b):
    x = len(a & b)
    return 10 * x >= 6 * (len(a) + len(b) - x)


def made(seed, n=120):
    r = random.Random(seed)
    words = [f"w{i}_{r.randint(0, 999)}" for i in range(900)]
    common = "the a of in is for with on that and".split()
    base = [[r.choice(common) for _ in range(8)] + r.sample(words, 22) for _ in range(n // 3)]
    rows = []
    for i in range(n):
        t = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 4, 6, 9])):
            t[r.randrange(len(t))] = r.choice(words)
        r.shuffle(t)
        rows.append((i, r.choice("ab"), " ".join(t)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pairs_equal_brute_force(spark, seed):
    rows = made(seed)
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and similar(tokens(a[2]), tokens(b[2]))}
    got = [tuple(x) for x in nd.near_duplicate_pairs(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got))
    assert set(got) <= want
    assert len(set(got)) >= 0.99 * len(want)


def test_equal_empty_long_and_repeated_rows(spark):
    long_ = " ".join(f"t{i}" for i in range(20000))
    rows = [(1, "a", ""), (2, "a", None), (3, "b", ""), (4, "a", long_), (5, "a", long_ + " more"), (6, "a", "X y!"), (7, "a", "x, Y"), (7, "a", "x, Y"), (8, "a", "ä ö")]
    got = {tuple(x) for x in nd.near_duplicate_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 2), (1, 8), (2, 8), (4, 5), (6, 7)}


def test_empty_table(spark):
    t = spark.createDataFrame([], SCHEMA)
    assert nd.near_duplicate_pairs(t).collect() == []
    assert nd.near_duplicate_groups(t).collect() == []


def test_nulls_and_clashing_columns(spark):
    rows = [(1, "Cat ", "one two three four", ("s",), 5, "x"), (2, " cat", "one two three four", ("s",), 5, "x"), (3, None, "one two three four", ("s",), 5, "x"), (4, "cat", None, ("s",), 5, "x"), (None, "cat", "one two three four", None, 5, "x")]
    t = spark.createDataFrame(rows, "finding_key long, category string, description string, evidence struct<snippet:string>, h long, keys string")
    assert [tuple(x) for x in nd.near_duplicate_pairs(nd.finding_texts(t)).collect()] == [(1, 2)]


def test_groups_chain_and_links(spark):
    w = [f"w{i}" for i in range(40)]
    rows = [(1, "a", " ".join(w[0:20])), (2, "a", " ".join(w[3:23])), (3, "a", " ".join(w[6:26])), (4, "a", " ".join(w[6:26])), (9, "a", "alone here")]
    got = {x.id: x for x in nd.near_duplicate_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i].group_id for i in (1, 2, 3, 4, 9)] == [1, 1, 1, 1, 9]
    assert (got[3].class_id, got[4].class_id, got[3].class_size) == (3, 3, 2)
    assert [got[i].links for i in (1, 2, 3, 9)] == [1, 3, 2, 0]


def test_components_of_long_chains_and_cycles(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(40, 1)] + [(100, k) for k in range(101, 160)]
    got = {x.node: x.component for x in nd.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and all(got[i] == 100 for i in range(100, 160))


FINDINGS = "finding_key long, batch_no int, finding_id string, description string, status string, h long, batch string"


def arrivals(spark, rows):
    return history.arrivals(spark.createDataFrame([(*r, 1, "clash") for r in rows], FINDINGS))


def brute(rows):
    out = set()
    for k, b, f, d, _ in rows:
        for k2, b2, f2, d2, s2 in rows:
            if b is None or b2 is None or k is None or b2 >= b:
                continue
            same = f is not None and f2 is not None and f.strip().lower() == f2.strip().lower()
            if same or (s2 in history.SETTLED and d is not None and d2 is not None and similar(tokens(d), tokens(d2))):
                out.add(k)
    return out


def history_rows(seed, n=150):
    r = random.Random(seed)
    states = [*history.SETTLED, "new", "skipped-dedup", None]
    return [(i, r.randint(1, 4), r.choice([None, f" F{r.randint(0, 60)} ", f"f{r.randint(0, 60)}"]), r.choice([t, t, t, None]), r.choice(states)) for i, _, t in made(seed, n)]


@pytest.mark.parametrize("seed", [5, 6])
def test_replay_equals_brute_force(spark, seed):
    rows = history_rows(seed)
    got = [x.finding_key for x in history.replay(arrivals(spark, rows)).collect()]
    want = brute(rows)
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.99 * len(want)


def test_replay_edges(spark):
    assert history.replay(arrivals(spark, [])).collect() == []
    rows = [(1, 1, None, None, "fixed"), (2, 2, None, None, "new"), (3, None, "a", "x", "fixed"), (None, 2, "a", "x", "new"), (4, 1, "B ", "", "fixed"), (5, 2, " b", "one", None), (6, 3, None, "", "new"), (7, 1, "z", "same text here", "fixed"), (8, 1, "y", "same text here", "new")]
    assert {x.finding_key for x in history.replay(arrivals(spark, rows)).collect()} == {5, 6}


def test_store_batch_by_batch_equals_replay(spark, tmp_path):
    rows = history_rows(7, 120)
    want = brute(rows)
    for send in (0, 1_000_000):
        store, got = history.HistoryStore(spark, f"file://{tmp_path}/store{send}", send), set()
        for b in range(1, 5):
            batch = arrivals(spark, [x for x in rows if x[1] == b])
            got |= {x.finding_key for x in store.check(batch).collect()}
            store.append(batch)
            store.append(batch)  # a retry
            if b == 3:
                assert store.stale()
                store.compact()
                assert not store.stale()
        assert got <= want and len(got) >= 0.98 * len(want)
        assert store.manifest()["batches"] == [1, 2, 3, 4] and len(store.manifest()["parts"]) == 2


def test_store_ignores_what_a_broken_append_left(spark, tmp_path, monkeypatch):
    store = history.HistoryStore(spark, f"file://{tmp_path}/store")
    one = arrivals(spark, [(1, 1, "a", "some text of this one", "fixed")])
    two = arrivals(spark, [(2, 2, "b", "another text with other words", "fixed")])
    later = arrivals(spark, [(3, 3, "c", "another text with other words", "new")])
    store.append(one)
    with monkeypatch.context() as m:
        m.setattr(store, "_publish", lambda manifest: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.append(two)
    assert store.check(later).collect() == []
    store.append(two)
    assert [x.finding_key for x in store.check(later).collect()] == [3]


def few_words():
    """Short texts of words that all count as common."""
    words = "unused import os name error".split()
    r = random.Random(3)
    texts = {"unused import", "unused import os"} | {" ".join(r.sample(words * 2 + [f"x{i}" for i in range(9)], r.randint(1, 10))) for _ in range(150)}
    return [(i, "a", t) for i, t in enumerate(sorted(texts))]


def test_sets_that_run_out_of_tokens_meet(spark):
    rows = few_words()
    short = [x for x in rows if len(tokens(x[2])) <= 8]
    table = nd.token_rows(spark.createDataFrame(short, SCHEMA), "id")
    ids = {x.h: x.id for x in table.groupBy("h").agg({"id": "min"}).withColumnRenamed("min(id)", "id").collect()}
    got = {tuple(sorted((ids[a], ids[b]))) for a, b in nd.class_pairs(table, region=0).collect()}
    known = {i: tokens(t) for i, _, t in short}
    want = {(a, b) for a in ids.values() for b in ids.values() if a < b and similar(known[a], known[b])}
    assert got == want and len(want) > 50


def test_replay_of_short_texts_of_common_words(spark):
    short = [x for x in few_words() if len(tokens(x[2])) <= 8]
    rows = [(i, 1 + i % 3, None, t, "fixed") for i, _, t in short]
    assert {x.finding_key for x in history.replay(arrivals(spark, rows), region=0).collect()} == brute(rows)


def sharing_a_template(n=400):
    """Pairs that share only the words of a template, which all rows have, and differ in all the rare ones."""
    r = random.Random(8)
    base = [f"c{i}" for i in range(24)]
    return [(i, 1 + i % 2, None, " ".join(r.sample(base, r.choice([15, 24])) + [f"own{i}_{j}" for j in range(8)]), "fixed" if i % 2 == 0 else "new") for i in range(n)]


@pytest.mark.parametrize("region", [3, 500])
def test_no_pair_depends_on_a_fingerprint(spark, region):
    rows = sharing_a_template()
    assert {x.finding_key for x in history.replay(arrivals(spark, rows), region=region).collect()} == brute(rows)
    assert 50 < len(brute(rows)) < 200


def test_store_finds_what_no_fingerprint_tells(spark, tmp_path):
    rows = sharing_a_template(120)
    store = history.HistoryStore(spark, f"file://{tmp_path}/store")
    store.append(arrivals(spark, [x for x in rows if x[1] == 1]))
    assert {x.finding_key for x in store.check(arrivals(spark, [x for x in rows if x[1] == 2])).collect()} == brute(rows)


def test_keys_do_not_change_with_the_size():
    r = np.random.default_rng(1)
    counts = np.append(r.integers(64, 1000, 1 << 10), round(64 * np.log2(1_000_000))).astype(np.uint16)
    flat, sizes = r.integers(0, 1 << 63, 6000, dtype=np.uint64) * np.uint64(2), np.full(200, 30)
    salt = np.zeros(200, dtype=np.uint64)
    keys = [signatures.Sampler(c, 18).keys(flat, sizes, salt) for c in (counts, counts + np.uint16(640), counts + np.uint16(64 * 40))]  # every count and the rows times 2**10, 2**40
    assert all((keys[0][0] == k[0]).all() and (keys[0][1] == k[1]).all() for k in keys)


def in_regions(keys, h, most, step):
    """The pairs of places that share a region, and the places left, from batches of ``step`` rows."""
    cut, pairs, left, done = signatures.Regions(most), set(), set(), 0
    feeds = [([keys[i : i + step], h[i : i + step]], False) for i in range(0, len(keys), step)] + [([keys[:0], h[:0]], True)]
    for cols, last in feeds:
        for got, number, depth, whole in cut.feed(cols, last):
            for i in range(len(number)):
                if not whole[i]:
                    left.add((int(got[0][i]), int(got[1][i])))
                pairs |= {(int(got[1][i]), int(got[1][j]), int(depth[i])) for j in range(i + 1, len(number)) if whole[i] and number[i] == number[j]}
    return pairs, left


@pytest.mark.parametrize("most", [1, 3, 8])
def test_regions_are_the_same_in_any_batches(most):
    r = random.Random(most)
    rows = sorted({(r.choice([0, 1, 1, 1, 5]) << signatures.HEAD | r.choice([0, 0, 1]) << signatures.AFTER | r.choice([0, 7]), r.randint(0, 400)) for _ in range(300)})
    keys, h = np.array([k for k, _ in rows], dtype=np.uint64), np.array([x for _, x in rows], dtype=np.int64)
    want = in_regions(keys, h, most, 10**6)
    for step in (1, 2, 7, 50):
        assert in_regions(keys, h, most, step) == want
    for k, x in rows:  # every row is in a region of at most so many rows, or left over in one that its whole key makes
        sizes = [sum(k >> s == k2 >> s for k2, _ in rows) for s in signatures.Regions.SHIFTS]
        assert ((k, x) in want[1]) == (sizes[-1] > most)


def test_rows_of_one_key_all_meet_whatever_a_region_may_hold(spark):
    rows = [(5 << signatures.HEAD | 3, i) for i in range(60)] * 2 + [(7 << signatures.HEAD | i % 2, 100 + i) for i in range(9)] + [(9 << signatures.HEAD, 7)]
    want = {(a, b) for k, a in rows for k2, b in rows if k == k2 and a < b}
    found = lambda cols, a, b, depth: [np.minimum(cols[1][a], cols[1][b]), np.maximum(cols[1][a], cols[1][b])]
    for region in (1, 4, 5, 100):
        near, left = signatures.neighbours(spark.createDataFrame(rows, "key long, h long"), found, [("a", pa.int64()), ("b", pa.int64())], region)
        got = [tuple(x) for x in near.collect()]
        rest = left.distinct().collect()
        assert len(got) == len(set(got))
        assert want <= set(got) | {(x.h, y.h) for x in rest for y in rest if x.key == y.key and x.h < y.h}
        assert bool(rest) == (region < 60)


def test_texts_of_one_template_meet(spark):
    r = random.Random(4)
    base = [f"c{i}" for i in range(30)]
    rows = [(i, "a", " ".join(base + r.sample([f"x{i}" for i in range(8)], 3))) for i in range(60)]
    table = nd.token_rows(spark.createDataFrame(rows, SCHEMA), "id")
    classes = len({tuple(sorted(x[2].split())) for x in rows})
    assert nd.class_pairs(table).count() == classes * (classes - 1) // 2
