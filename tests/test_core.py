import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quern.functions import pysource, scalars as S
from quern.functions.pysource import ADAPTERS
from quern.operators import cascade, chunks, graph, joins, ranking, resolve, vectors
from quern.plans import examples, text
from quern.sources import sinks, state
from quern.streaming import events


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'long'}" for k, v in values.items()))
    return df.select(col.alias("x")).first()[0]


def test_scalars(spark):
    p = F.col("p")
    for path, lang, par, st, test in (("a/b/test_c.py", "python", "a/b", "test_c", True), ("X.TS", "typescript", ".", "X", False), ("tests/q", "unknown", "tests", "q", True), ("a.b/c.zz", "zz", "a.b", "c", False)):
        df = spark.createDataFrame([(path,)], "p string").select(S.language(p), S.parent(p), S.stem(p), S.is_test(p)).first()
        assert tuple(df) == (lang, par, st, test)
    for text, n in (("", 0), ("a", 1), ("a\n", 1), ("a\nb", 2), ("a\r\nb\r\n", 2), ("\n\n", 2)):
        assert one(spark, S.line_count(F.col("t")), t=text) == n == len(text.splitlines())
    assert one(spark, S.tidy(F.col("t")), t=" \tAb c\n") == "ab c"
    assert one(spark, S.truncated(F.col("t"), 3), t="abcdef") == "abc... (3 more)"
    assert one(spark, S.glob_to_regex(F.col("t")), t="a.*/b?") == r"^a\..*/b.$"
    for a, b, d in ((255, 0, 8), (0, 0, 0), (10, 5, 4)):
        assert one(spark, S.hamming(F.col("a"), F.col("b")), a=a, b=b) == d
    assert one(spark, S.impact(F.col("a"), F.col("b")), a=3, b=100) == pytest.approx(0.30037, abs=1e-4)


def test_callers_within_bounds_and_cycles(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("a", "d"), ("e", "d")], "caller string, callee string")
    s = spark.createDataFrame([("s", "a")], "seed string, symbol_id string")
    for depth, want in ((0, {}), (1, {"b": 1}), (3, {"b": 1, "c": 2, "d": 3}), (9, {"b": 1, "c": 2, "d": 3, "e": 4})):
        assert {x.symbol_id: x.depth for x in graph.callers_within(e, s, depth).collect()} == want


def test_tiers_by_index(spark):
    vals = [5, 1, 9, 9, 3, 7, 2]
    df = spark.createDataFrame(list(enumerate(vals)), "id int, v int")
    s = sorted(vals)
    q1, q3 = s[len(s) // 4], s[3 * len(s) // 4]
    for x in graph.tiers(df, "v").collect():
        assert x.tier == ("high" if x.v >= q3 else "low" if x.v <= q1 else "medium")
    few = spark.createDataFrame([(1, 4), (2, 8)], "id int, v int")
    assert {x.id: x.tier for x in graph.tiers(few, "v").collect()} == {1: "low", 2: "high"}


def test_snapshot_diff_is_null_safe(spark):
    a = spark.createDataFrame([("x", "1"), ("y", None), ("z", "1"), ("w", "1")], "k string, v string")
    b = spark.createDataFrame([("x", "1"), ("y", None), ("z", None), ("v", "1")], "k string, v string")
    assert {r.k: r.state for r in graph.snapshot_diff(a, b, ["k"], "v").collect()} == {"x": "same", "y": "same", "z": "dirty", "w": "deleted", "v": "added"}


def test_chunks_cover_and_sample(spark):
    df = spark.createDataFrame([(1, 5), (2, 260), (3, 261), (4, 1000), (5, 0)], "file_id long, n int")
    got = chunks.line_chunks(df).collect()
    for f, n in ((1, 5), (2, 260), (3, 261), (4, 1000)):
        mine = sorted((x.first_line, x.last_line) for x in got if x.file_id == f)
        assert mine[0][0] == 1 and mine[-1][1] == n
        assert all(b[0] == a[1] - 39 for a, b in zip(mine, mine[1:], strict=False))
    assert not [x for x in got if x.file_id == 5]
    many = spark.range(20).selectExpr("1 as k", "id as o")
    assert sorted(x.o for x in chunks.sample_even(many, "k", "o", 6).collect()) == sorted({round(i * 19 / 5) for i in range(6)})


def test_gini_equals_the_plain_formula(spark):
    r = random.Random(1)
    vals = [r.choice([0, 1, 1, 2, 50]) for _ in range(60)]
    got = ranking.gini(spark.createDataFrame([("g", v) for v in vals] + [("z", 0), ("o", 3)], "g string, v int"), ["g"], "v").collect()
    x, n = sorted(vals), len(vals)
    want = 2 * sum(i * v for i, v in enumerate(x, 1)) / (n * sum(x)) - (n + 1) / n
    g = {a.g: a.gini for a in got}
    assert g["g"] == pytest.approx(want, abs=1e-6) and g["z"] == 0 and g["o"] == 0


def test_topk_with_quota(spark):
    df = spark.createDataFrame([("g", i, 100 - i, i % 3) for i in range(12)], "g string, id int, score int, used int")
    got = ranking.topk_with_quota(df, ["g"], ["id"], 6, [F.desc("score"), F.asc("id")], [F.asc("used"), F.asc("id")]).collect()
    assert sorted(x.id for x in got if x.chosen_by == "priority") == [0, 1, 2, 3] and sorted(x.id for x in got if x.chosen_by == "diversity") == [6, 9]


def test_as_of_equals_brute_force(spark):
    r = random.Random(2)
    t0 = datetime(2025, 1, 1)
    row = lambda i: (i, r.choice(["a", "b", None]), t0 + timedelta(hours=r.randint(0, 4000)))
    left, right = [row(i) for i in range(150)], [row(1000 + i) for i in range(60)]
    schema = "id long, k string, t timestamp"
    got = {x.id: x.match_key for x in joins.as_of(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"], "t", "id", 5).collect()}
    want = {}
    for i, k, t in left:
        c = [(t2, j) for j, k2, t2 in right if k is not None and k2 == k and t2 < t]
        if c:
            want[i] = max(c)[1]
    assert got == want


def test_band_equals_brute_force(spark):
    spots = [("f", v, v) for v in (1, 3, 4, 9, 14, 15, 21, 100)]
    got = {(x.v_a, x.v_b) for x in joins.band(spark.createDataFrame(spots, "k string, v int, first_key long"), ["k"], "v", 5).collect()}
    assert got == {(a, b) for _, a, _ in spots for _, b, _ in spots if 0 < b - a <= 5}


def test_hamming_pairs_are_exact(spark):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(20)]
    sigs = {b for b in base} | {b ^ sum(1 << k for k in r.sample(range(64), r.randint(1, 5))) for b in base for _ in range(4)}
    sigs = [s - (1 << 64) if s >> 63 else s for s in sigs]
    got = {(x.a, x.b): x.distance for x in vectors.hamming_pairs(spark.createDataFrame([(s,) for s in sigs], "sig long")).collect()}
    dist = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count()
    assert got == {(a, b): dist(a, b) for a in sigs for b in sigs if a < b and dist(a, b) <= 3}


def test_nearest_in_blocks_equals_one_block(spark):
    r = random.Random(5)
    rows = [(i, [r.random() - 0.5 for _ in range(8)]) for i in range(60)] + [(99, [0.0] * 8)]
    t = spark.createDataFrame(rows, "id long, v array<double>")
    q = t.where("id % 5 = 0")
    key = lambda df: sorted((x.qid, x.place, x.id) for x in df.collect())
    a = key(vectors.nearest(q, t, 3))
    assert a == key(vectors.nearest(q, t, 3, most=4)) and len(a) == 3 * q.count()
    v = dict(rows)
    cos = lambda x, y: (sum(p * s for p, s in zip(x, y, strict=True)) / (sum(p * p for p in x) ** 0.5 * sum(s * s for s in y) ** 0.5)) if any(x) and any(y) else 0.0
    for i in range(0, 60, 5):
        assert [x[2] for x in a if x[0] == i] == sorted((j for j in v if j != i), key=lambda j: (-round(cos(v[i], v[j]), 9), j))[:3]


def test_leaders_equal_a_sequential_fold(spark):
    r = random.Random(6)
    n = 60
    pairs = {tuple(sorted(r.sample(range(n), 2))) for _ in range(90)}
    near = lambda a, b: (min(a, b), max(a, b)) in pairs
    leaders, want = [], {}
    for i in range(n):
        want[i] = next((x for x in leaders if near(i, x)), i)
        leaders += [i] * (want[i] == i)
    items = spark.createDataFrame([(i, i) for i in range(n)], "sig long, at long")
    got = cascade.leaders(items, spark.createDataFrame(list(pairs), "a long, b long"))
    assert {x.sig: x.leader for x in got.collect()} == want


def test_udtfs(spark):
    src = "import os, a.b as c\nfrom x import *\nfrom . import y\n__all__ = ['y']\nclass A:\n    def m(self):\n        def inner(): pass\n        return c\n@dec\nasync def f(): eval('1')\n"
    rows = lambda what, s: [tuple(x) for x in ADAPTERS[".py"][what](F.lit(s)).collect()]
    assert rows("symbols", src) == [("A", "class", 5, 8), ("m", "method", 6, 8), ("f", "function", 10, 10)]
    assert {x[1] for x in rows("imports", src)} == {"os", "c", "y"}
    assert ("y", True) in rows("references", src) and ("c", False) in rows("references", src)
    assert rows("signals", src) == [("dynamic_execution", 10)] and rows("signals", "def (") == [("syntax_error", 1)] and rows("symbols", "def (") == []


def test_edges_from_source(spark):
    f, files = examples.tree(spark, repos=(1, 2))
    assert {(x.repo_id, x.caller, x.callee) for x in resolve.edges(f, files).collect()} == {(r, *e) for r in (1, 2) for e in examples.EDGES}
    got = {(x.relpath, x.bound, x.target, x.symbol) for x in resolve.targets(f, files).where("repo_id = 1").collect()}
    assert ("app/sub/deep.py", "util", "app/util.py", None) in got and ("app/main.py", "app", "app/util.py", None) in got and ("app/main.py", "missing", "app/util.py", "missing") in got
    assert not any(b in ("x", "y", "path") for _, b, _, _ in got)
    one = [x for x in f.where("repo_id = 1 and kind = 'signal'").collect()]
    assert [(x.relpath, x.name) for x in one] == [("app/broken.py", "syntax_error")]
    none, nofiles = examples.tree(spark, {"a.py": "", "b.py": None, "c.rb": "x"})
    assert none.collect() == [] and resolve.edges(none, nofiles).collect() == []


def test_outlines_of_other_languages(spark):
    f, _ = examples.tree(spark, {
        "a.ts": "import { x } from './lib/x';\nimport 'side';\nexport async function go(a: number) {}\nexport default class Box {}\ninterface Shape {}\nexport const add = (a: number): number => a;\nconst n = 3;\n  function inner() {}\n",
        "b.go": 'package main\n\nimport (\n\t"fmt"\n\tlog "my/log"\n)\n\nfunc Run() {}\nfunc (s *Set) Add(x int) {}\ntype Set struct {}\n',
    })
    got = {(x.relpath, x.kind, x.name or x.bound, x.of, x.start_line) for x in f.collect()}
    assert got == {
        ("a.ts", "import", "x", "./lib/x", 1), ("a.ts", "import", "side", "side", 2), ("a.ts", "symbol", "go", "function", 3), ("a.ts", "symbol", "Box", "class", 4), ("a.ts", "symbol", "Shape", "interface", 5), ("a.ts", "symbol", "add", "function", 6),
        ("b.go", "import", "fmt", "fmt", 4), ("b.go", "import", "log", "my/log", 5), ("b.go", "symbol", "Run", "function", 8), ("b.go", "symbol", "Add", "method", 9), ("b.go", "symbol", "Set", "class", 10),
    }
    assert not pysource.register(".py", pysource.FACTS[".go"])


def test_unused_imports_and_reexports(spark, tmp_path):
    rows = [(1, 1, "m/a.py", "import os\nfrom x import y, _z\nfrom q import kept\n__all__ = ['kept']\n"), (2, 1, "m/b.py", "from m.a import y\ny\n"), (3, 2, "c.py", "import os, re\nre.x\n"), (4, 3, "d.py", None)]
    df = spark.createDataFrame([(i, r, p, t.split("\n") if t is not None else None) for i, r, p, t in rows], "file_id long, repo_id int, relpath string, lines array<string>")
    df.write.parquet(f"{tmp_path}/parse_results.parquet")
    got = {(x.file_id, x.bound): x.around for x in text.unused_imports(spark, str(tmp_path)).collect()}
    assert set(got) == {(1, "os"), (1, "y"), (1, "_z"), (3, "os")} and got[(1, "y")] == "import os\nfrom x import y, _z\nfrom q import kept"
    assert {(x.file_id, x.names, x.unused) for x in text.unused_imports_by_file(spark, str(tmp_path)).collect()} == {(1, "os", 1), (3, "os", 1)}


def test_rounding_is_pythons(spark):
    r = random.Random(1)
    xs = [2.675, 0.5, 1.5, 2.5, -0.5, -2.675, 0.125, 0.375, 1.0005, 1.0015, 2.0025, 1e17, 0.0, -1.0045, 5e-324, 4503599627370497.5] + [round(r.uniform(-999, 999), 4) for _ in range(3000)] + [r.randint(-9999, 9999) / 2000 for _ in range(2000)] + [r.random() for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for n in (0, 3, 4, 6):
        got = [x.y for x in df.select(S.py_round(F.col("x"), n).alias("y")).collect()]
        assert [(x, a) for x, a in zip(xs, got, strict=True) if a != round(x, n)] == []


@pytest.mark.parametrize("text_", ["", "a", "a\n", "\n", "a\r\nb\rc", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g\u2028h\u2029", "a\n\n", "\r\n\r\n", "x\ty z", "\u2029"])
def test_lines_are_those_of_splitlines(spark, text_):
    assert one(spark, S.line_count(F.col("t")), t=text_) == len(text_.splitlines())


def test_small_functions(spark):
    import hashlib

    get = lambda col: spark.range(1).select(col.alias("x")).first()[0]
    lit = F.lit
    assert get(S.contains_either(lit("Unused Import"), lit("import"))) and get(S.contains_either(lit("a"), lit("CAT"))) and not get(S.contains_either(lit(""), lit("x"))) and not get(S.contains_either(lit(None).cast("string"), lit("x")))
    assert [get(S.bound_name(lit(x))) for x in ("a.b.c", "a", "")] == ["a", "a", ""]
    assert [get(S.symbol_kind(lit(x).cast("string"))) for x in ("class", "method", "enum", None)] == ["class", "method", "function", "function"]
    assert get(S.scan_id(F.to_timestamp(lit("2025-03-04 05:06:07")), lit("ABCDEF0123"))) == "20250304T050607Z-abcdef01"
    names = lambda *n: F.array(*[lit(x) for x in n]) if n else F.expr("cast(array() as array<string>)")
    none = lit(None).cast("string")
    assert [get(S.test_command(names(*n), m)) for n, m in ((("setup.py", "package.json"), none), (("Cargo.toml",), none), (("Makefile",), lit("all:\ntest: all\n")), (("Makefile",), lit("tests:")), ((), none))] == ["npm test", "cargo test", "make test", None, None]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for sums in (b"s", None):
        assert get(S.module_key(lit("/r/m"), lit(b"mod"), lit(sums).cast("binary"))) == sha(f"/r/m|{sha(b'mod')}|{sha(sums or b'')}".encode())
    assert [get(S.told_severity(lit(x).cast("string"))) for x in ("Remote Code execution, high", "SQL injection", "Moderate leak", "odd", None)] == ["critical", "high", "medium", "low", "low"]
    assert [get(S.change_quality(lit(a), lit(b), lit(c), lit(e), lit(g))) for a, b, c, e, g in ((0, 1, 3, 0, True), (40, 3, 0, 0, False), (4000, 99, 1, 1, False), (100, 1, 0, 0, True))] == [1.0, 0.8, 0.4, 0.78]
    words = lambda s: F.split(lit(s), " ")
    assert [get(S.allowed_command(words(x))) for x in ("python -m pytest -q", "pytest", "git log -1", "git push", "python -m pip", "rm")] == [True, True, True, False, False, False]
    assert [get(S.inside(lit(x).cast("string"))) for x in ("a/b.py", "a/../b", "../x", "a/../../x", "/etc", "a/.git/x", "./a//b", None)] == [True, True, False, False, False, False, True, False]


def test_readers_of_registries_and_clusters(spark, tmp_path):
    at = f"file://{tmp_path}"
    files = {
        "reg.json": json.dumps({"repos": [{"path": "/a", "name": "a", "enabled": True}, {"name": "lost"}, {"path": ""}]}), "list.json": json.dumps([{"path": "/b"}]), "bad.json": "{oops",
        "c.json": json.dumps({"schema_version": "v1", "clusters": [
            {"cluster_id": "c1", "canonical_fingerprint": "f", "member_fingerprints": ["f", "g"], "simhash_signature": "ffffffffffffffff", "embedding_centroid": [0.5], "first_seen": "a", "last_seen": "b", "occurrence_count": 2},
            {"cluster_id": "c2", "canonical_fingerprint": "f", "member_fingerprints": ["f"], "simhash_signature": 7, "embedding_centroid": None, "first_seen": "a", "last_seen": "b", "occurrence_count": 1},
            {"cluster_id": "c3"}, {"cluster_id": "c4", "canonical_fingerprint": "f", "member_fingerprints": ["f"], "simhash_signature": "zz", "first_seen": "a", "last_seen": "b", "occurrence_count": 1}]}),
        "d1.json": json.dumps({"task_id": "t1", "repair_cycle_count": 3, "findings_by_category": {"a": 2}}), "d2.json": "[1]", "d3.json": "nothing",
        "prs.jsonl": '{"number": 4, "state": "MERGED", "mergedAt": "2025-01-01T00:00:00Z", "createdAt": null, "title": "x"}\nnot json\n{"state": "open"}\n',
    }
    for name, body in files.items():
        (tmp_path / name).write_text(body)
    assert [(x.path, x.name) for x in state.registry(spark, f"{at}/reg.json").collect()] == [("/a", "a")] and state.registry(spark, f"{at}/list.json").first().path == "/b" and state.registry(spark, f"{at}/bad.json").collect() == []
    got = state.clusters_json(spark, f"{at}/c.json", "v1").collect()
    assert [(x.cluster_id, x.simhash_signature) for x in got] == [("c1", -1), ("c2", 7)] and state.clusters_json(spark, f"{at}/c.json", "v2").collect() == []
    docs = state.json_documents(spark, f"{at}/d*.json", "task_id string, repair_cycle_count int, findings_by_category map<string,int>").collect()
    assert [(x.task_id, x.findings_by_category) for x in docs] == [("t1", {"a": 2})] and docs[0].path.endswith("d1.json")
    assert [(x.number, x.state, str(x.merged_at)) for x in state.outcomes(spark, f"{at}/prs.jsonl").collect()] == [(4, "merged", "2025-01-01 00:00:00")]
    assert state.first_existing(spark, [f"{at}/gone", f"{at}/c.json", f"{at}/reg.json"]) == f"{at}/c.json" and state.first_existing(spark, []) is None
    paths = spark.createDataFrame([("b",), ("a/.git/x",), ("a/x",), ("b",), ("../y",)], "path string")
    assert [x.path for x in state.listing(paths, 2).collect()] == ["a/x", "b"]


def test_suppressions_and_manifests(spark, tmp_path):
    none = spark.createDataFrame([], "finding_id string, category string, path_prefix string, reason string, until string")
    rules = sinks.suppress(sinks.suppress(none, {"finding_id": "f1", "reason": "known"}, 7, "2025-01-01"), {"category": "dead-code", "path_prefix": "lib/"}, 1, "2025-01-01")
    assert [(x.finding_id, x.category, x.until) for x in rules.collect()] == [("f1", None, "2025-01-08T00:00:00Z"), (None, "dead-code", "2025-01-02T00:00:00Z")]
    assert [x.finding_id for x in sinks.unsuppress(rules, category="dead-code", finding_id=None, path_prefix="").collect()] == ["f1"]
    assert sinks.unsuppress(rules, finding_id="f1", path_prefix="lib/").collect() == [] and sinks.unsuppress(rules).count() == 2
    sinks.scan_manifest(spark, f"{tmp_path}/scans", "s1", "started", "2025-01-01T00:00:00Z")
    sinks.scan_manifest(spark, f"{tmp_path}/scans", "s1", "completed", "2025-01-01T00:01:00Z")
    assert spark.read.json(f"{tmp_path}/scans").count() == 2
    with pytest.raises(ValueError):
        sinks.scan_manifest(spark, f"{tmp_path}/scans", "s1", "lost", "x")
    rules.write.parquet(f"{tmp_path}/rules")
    sinks.clear(spark.read.parquet(f"{tmp_path}/rules"), f"{tmp_path}/none")
    assert spark.read.parquet(f"{tmp_path}/none").columns == rules.columns and spark.read.parquet(f"{tmp_path}/none").count() == 0
    shards = spark.createDataFrame([("ab" * 32, "p.py::f"), ("ab" * 32, "p.py::g"), ("cd" * 32, "q.py::h")], "hash string, symbol_id string")
    sinks.write_shards(shards, f"{tmp_path}/shards")
    find = lambda i: [x.symbol_id for x in sinks.lookup_symbol(spark, f"{tmp_path}/shards", i, {"p.py": "ab" * 32}).collect()]
    assert find("p.py::g") == ["p.py::g"] and find("p.py::x") == [] and find("q.py::h") == []
    assert [x.hash for x in sinks.missing_shards(spark.createDataFrame([("ab" * 32,), ("ee" * 32,)], "hash string"), shards).collect()] == ["ee" * 32]


def test_late_rows_are_dropped_and_streams_join(spark, tmp_path):
    schema = "ts timestamp, event_type string, user_id long, event_id long, value double"

    def put(n, rows):
        spark.createDataFrame([(datetime(2025, 1, day, hour), t, u, e, 1.0) for day, hour, t, u, e in rows], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")

    read = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    put(0, [(1, 1, "a", 1, 1), (1, 3, "b", 1, 2), (9, 1, "a", 1, 3), (9, 2, "b", 1, 6)])
    run = lambda s, name, mode: s.writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/{name}-cp").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    run(events.daily_counts(read()), "days", "append")
    joined = lambda: events.followed(read().where("event_type = 'a'"), read().where("event_type = 'b'"))
    run(joined(), "pairs", "append")
    put(1, [(1, 2, "a", 1, 4), (1, 4, "b", 1, 5), (20, 1, "c", 1, 7)])  # the first two are a week late
    run(events.daily_counts(read()), "days", "append")
    run(joined(), "pairs", "append")
    days = {(x.day, x.event_type): x.events for x in spark.read.parquet(f"{tmp_path}/days").collect()}
    first, ninth = int(datetime(2025, 1, 1).timestamp()), int(datetime(2025, 1, 9).timestamp())
    assert days[(first, "a")] == 1 and days[(first, "b")] == 1 and days[(ninth, "a")] == 1 and days[(ninth, "b")] == 1
    assert {(x.first, x.later) for x in spark.read.parquet(f"{tmp_path}/pairs").collect()} == {(1, 2), (3, 6)}


def test_hashes_without_builtins(spark):
    import hashlib

    from quern.functions.pyhash import base58, blake2b_64

    df = spark.createDataFrame([("token", bytearray(b"\0\0hello world")), (None, None), ("", bytearray(b""))], "t string, b binary")
    got = [tuple(x) for x in df.select(blake2b_64("t"), base58("b")).collect()]
    assert got[0] == (int.from_bytes(hashlib.blake2b(b"token", digest_size=8).digest(), signed=True), "11StV1DL6CwTryKyV") and got[1] == (None, None) and got[2][1] == ""


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"finding_id": "1", "found_at": "2025-01-02T03:04:05Z", "evidence": {"file": "x", "line": 3}}]))
    (tmp_path / "b.json").write_text(json.dumps({"findings": [{"finding_id": "2", "found_at": "nonsense"}]}))
    (tmp_path / "c.json").write_text("{broken")
    got = {x.finding_id: x.found_at for x in state.findings_json(spark, f"{tmp_path}/*.json").collect()}
    assert got == {"1": datetime(2025, 1, 2, 3, 4, 5), "2": None}
    (tmp_path / "s.txt").write_text(json.dumps({"files": {"p": {"content_hash": "h"}}}))
    assert [(x.path, x.content_hash) for x in state.crawl_state(spark, f"{tmp_path}/s.txt").collect()] == [("p", "h")]
    (tmp_path / "n.txt").write_text(json.dumps({"vulnerabilities": {"q": {"severity": "high"}}}))
    assert [tuple(x) for x in state.npm_audit_json(spark, f"{tmp_path}/n.txt").collect()] == [("q", "q", "high")]
    (tmp_path / "p.txt").write_text(json.dumps({"dependencies": [{"name": "a", "version": "1", "vulns": [{"id": "X", "description": "Remote code execution"}]}]}))
    assert state.audit_json(spark, f"{tmp_path}/p.txt").first().severity == "critical"
    for text, n in (("15m", 900), ("2h", 7200), ("0m", None), ("x", None), ("5d", None)):
        assert one(spark, state.duration_seconds(F.col("t")), t=text) == n
    md = spark.createDataFrame([(1, "# A\n| x | y |\n|---|---|\n| 1 | 2 |\n## B\n| z |")], "id long, text string")
    assert [(x.section, x.cells) for x in state.markdown_rows(md).orderBy("pos").collect()] == [("A", ["x", "y"]), ("A", ["1", "2"]), ("B", ["z"])]
    for text, want in (("```json\n[1]\n```", "[1]"), ("so: [1, 2] there", "[1, 2]"), ("none", None)):
        assert one(spark, state.json_array(F.col("t")), t=text) == want
    conf = spark.createDataFrame([({"a": "9", "zz": "1"},)], "o map<string,string>").select(state.merged_config({"a": "1", "b": "2"}, F.col("o")).alias("m")).first().m
    assert conf == {"a": "9", "b": "2"}
    (tmp_path / "t/.git").mkdir(parents=True)
    (tmp_path / "t/.git/x.py").write_text("1")
    (tmp_path / "t/y.py").write_text("2")
    assert [x.path.rsplit("/", 1)[1] for x in state.source_files(spark, f"{tmp_path}/t", "*.py").collect()] == ["y.py"]


def test_sinks(spark, tmp_path):
    ev = spark.createDataFrame([("ScanStarted", datetime(2025, 1, 1), "e1", "{}")], "event string, at timestamp, event_id string, payload string")
    sinks.append_events(ev, f"{tmp_path}/ev")
    sinks.append_events(ev, f"{tmp_path}/ev")
    assert spark.read.json(f"{tmp_path}/ev").count() == 2
    with pytest.raises(Exception, match="unknown event"):
        sinks.append_events(ev.withColumn("event", F.lit("Nope")), f"{tmp_path}/ev")
    res = spark.createDataFrame([("r", "error", "m", "b.py", 2), ("r", "note", 'q"', "a.py", 1)], "rule_id string, level string, message string, uri string, start_line int")
    sinks.write_sarif(res, f"{tmp_path}/sarif")
    text = "".join(p.read_text() for p in sorted((tmp_path / "sarif").rglob("part-*")))
    doc = json.loads(text)
    assert [x["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] for x in doc["runs"][0]["results"]] == ["a.py", "b.py"]
    docs = spark.createDataFrame([("abcd01", 1), ("abce02", 2)], "hash string, v int")
    sinks.write_shards(docs, f"{tmp_path}/sh")
    sinks.write_shards(docs.where("v = 2").withColumn("v", F.lit(3)), f"{tmp_path}/sh")
    assert sinks.read_shard(spark, f"{tmp_path}/sh", "abcd01").first().v == 1 and sinks.read_shard(spark, f"{tmp_path}/sh", "abce02").first().v == 3
    for v in ("1", "2"):
        sinks.publish(docs.withColumn("n", F.lit(v)), f"{tmp_path}/pub", v)
    assert sinks.published(spark, f"{tmp_path}/pub").first().n == "2"
    cur = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    ch = spark.createDataFrame([("b", 2, 1), ("b", 3, 2), ("c", 4, 1)], "k string, v int, seq int")
    assert {tuple(x) for x in sinks.upsert(cur, ch, ["k"]).collect()} == {("a", 1), ("b", 3), ("c", 4)}
    sinks.snapshot(cur, f"{tmp_path}/snap", "s1")
    sinks.snapshot(cur.limit(1), f"{tmp_path}/snap", "s2")
    assert spark.read.parquet(f"{tmp_path}/snap").count() == 3
    with pytest.raises(ValueError):
        sinks.snapshot(cur, f"{tmp_path}/snap", "../x")


def test_stream_to_files_survives_a_restart(spark, data, tmp_path):

    for _ in range(2):
        events.sink(events.unique_events(events.replay(spark, data)), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == spark.read.parquet(f"{data}/events.parquet").count()


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


CORE = [k for k in entry.queries() if not (k[0] == "p" and k[1].isdigit())]


@pytest.mark.parametrize("name", CORE)
def test_queries_equal_their_sql(spark, data, name):
    import os

    import duckdb

    got = entry.queries()[name](spark, data).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{data}/{f}')")
    want = con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)

    def rows(x):
        form = lambda v: "NULL" if v is None or v != v else f"{float(v):.9g}" if isinstance(v, int | float) or hasattr(v, "dtype") else str(v)
        return sorted(tuple(form(v) for v in r) for r in x[sorted(x.columns)].itertuples(index=False))

    assert rows(got) == rows(want)
