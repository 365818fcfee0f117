import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import embedding
from lodestone.functions import text as X
from lodestone.functions import vectors as V
from lodestone.operators import blocks, chunking, evaluation, ranges, ranks, similarity, store
from lodestone.plans import search as S
from lodestone.sources import files
from lodestone.streaming import queue, state


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_paths_and_names(spark):
    rows = ["src/a", "src/a/b", "src/a.rs", "src/a.b.rs", "src/ab", "src"]
    df = spark.createDataFrame([(r,) for r in rows], "p string")
    assert values(df, X.path_prefix(F.col("p"), "src/a/")) == [True, True, True, False, False, False]
    names = spark.createDataFrame([("Foo_Hent",), (None,), ("x",)], "n string")
    assert values(names, X.name_hit(F.col("n"), ["hent"])) == [True, False, False]
    assert X.language_alias(" C++ ") == "cpp"
    with pytest.raises(ValueError):
        X.language_alias("cobol")


def test_times(spark):
    df = spark.createDataFrame([("2024-02-29T00:00:00Z",), ("2023-02-29T00:00:00Z",), ("2024-01-01 00:00:00Z",), (None,)], "s string")
    assert [v is not None for v in values(df, X.parse_rfc3339(F.col("s")))] == [True, False, False, False]


def test_cosine_guards(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), ([], [])], "a array<double>, b array<double>")
    assert values(df, V.cosine(F.col("a"), F.col("b"))) == [1.0, 0.0, 0.0, 0.0]


def test_global_rank_is_row_number(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([0.0, 0.5, round(rng.random(), 3)])) for k in range(300)]
    df = V.global_rank(spark.createDataFrame(rows, "k int, s double"), "s", ["k"], "r")
    order = sorted((r for r in rows if r[1] > 0), key=lambda r: (-r[1], r[0]))
    want = {k: n for n, (k, _) in enumerate(order, 1)}
    assert {r.k: r.r for r in df.collect()} == {k: want.get(k) for k, _ in rows}


def test_search_gates(spark):
    rows = [("r", f"f{k}", 0, k, "en", None, t, v) for k, (t, v) in enumerate([("alpha beta", [0.0, 1.0]), ("gamma", [1.0, 0.0]), ("alpha", None), ("delta", [0.0, 1.0])])]
    df = spark.createDataFrame(rows, "repo string, file_path string, byte_start int, chunk_id long, language string, name string, content string, vector array<float>")
    got = [r.chunk_id for r in S.search(df, "alpha", [1.0, 0.0]).collect()]
    assert 3 not in got and set(got) == {0, 1, 2}
    assert S.search(df, "?!", None).count() == 0
    assert S.search(df.limit(0), "alpha", [1.0, 0.0]).count() == 0


def test_pairs_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 16)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4))
    rows = [("r", f"f{k % 7}", k, [float(v) for v in x[k]]) for k in range(60)]
    df = spark.createDataFrame(rows, "repo string, file_path string, chunk_id long, vector array<double>")
    got = {(r.a_chunk, r.b_chunk) for r in similarity.duplicate_pairs(df, 0.8, None).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {frozenset((a, b)) for a in range(60) for b in range(a) if a % 7 != b % 7 and u[a] @ u[b] >= 0.8}
    assert {frozenset(p) for p in got} == want and len(got) == len(want)
    with pytest.raises(similarity.TooManyChunks):
        similarity.duplicate_pairs(df, 0.8, cap=10)


def test_floor_rules(spark):
    df = spark.createDataFrame([(f"f{k}", k, [1.0, 0.0]) for k in range(5)], "file_path string, chunk_id long, vector array<double>")
    assert similarity.corpus_floor(df) is None
    assert similarity.resolve_floor(0.8, 0.7) == 0.7 and similarity.resolve_floor(0.9, 0.7) == 0.9 and similarity.resolve_floor(0.5, None) == 0.5


def test_ranges_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice("ab"), s := rng.randrange(30), s + rng.randrange(9)) for k in range(120)]
    df = spark.createDataFrame(rows, "k int, file_path string, line_start long, line_end long")
    seen = spark.createDataFrame(rows[:20], df.schema)
    want = {k for k, f, s, e in rows[20:] if not any(g == f and a <= s and b >= e for _, g, a, b in rows[:20])}
    assert set(values(ranges.unseen(df.where("k >= 20"), seen, ["file_path"]), "k")) == want
    want = {k for k, f, s, e in rows if not any(g == f and a >= s and b <= e and (a, b) != (s, e) for _, g, a, b in rows)}
    assert set(values(ranges.innermost(df, "line_start", "line_end"), "k")) == want


def test_text_chunks():
    data = b"".join(b"line %d of some text\n" % k for k in range(300))
    own = chunking.text_chunks(data)
    assert own[0].start == 0 and own[-1].end == len(data)
    assert all(b.start <= a.end for a, b in zip(own, own[1:], strict=False))
    body = [c for c in own[1:]]
    assert all(data[: c.start].endswith(b"\n") for c in body)
    assert chunking.text_chunks(b"") == []
    assert chunking.chunk_file(b"\xff\xfe", "python") == [] and chunking.chunk_file(b"x", "unknown") == []
    # an edit changes few chunks
    new = chunking.text_chunks(data.replace(b"line 150 ", b"line 150 changed "))
    texts = lambda cs, d: {d[c.start : c.end] for c in cs}
    assert len(texts(own, data) & texts(new, data.replace(b"line 150 ", b"line 150 changed "))) >= len(own) - 2


@pytest.mark.parametrize(
    "language, code, want",
    [
        ("python", "@d\ndef f():\n    def g(): pass\nclass C:\n    def m(self): pass\n", {("function", "f"), ("function", None), ("function", "g"), ("class", "C"), ("function", "m")}),
        ("rust", "/// doc\npub fn a() {}\nmod x;\nmod y { fn b() {} }\nstruct S;\nimpl S { fn m(&self) { let s = \"}\"; } }\ntrait T { fn t(&self); }\n", {("function", "a"), ("module", "y"), ("function", "b"), ("struct", "S"), ("impl", None), ("method", "m"), ("trait", "T"), ("method", "t")}),
        ("go", "func F() {}\nfunc (r *R) M() {}\ntype R struct { x int }\ntype I interface { F() }\n", {("function", "F"), ("method", "M"), ("struct", None), ("interface", None)}),
        ("java", "class A {\n  int f(int x) { return x; }\n}\ninterface B {}\nenum E { X }\n", {("class", "A"), ("method", "f"), ("interface", "B"), ("enum", "E")}),
        ("typescript", "export function f() {}\nconst g = (x) => { return x; };\nclass C {\n  m() {}\n}\ninterface I {}\n", {("function", "f"), ("function", "g"), ("class", "C"), ("method", "m"), ("interface", "I")}),
        ("c", "#define X 1\nint main(void) {\n  return 0;\n}\nstruct p { int x; };\ntypedef struct { int y; } q;\n", {("macro", "X"), ("function", "main"), ("struct", "p"), ("struct", "q")}),
        ("cpp", "namespace n {\nclass C {\n  int m() { return 1; }\n};\nint f() { return 2; }\n}\n", {("module", "n"), ("class", "C"), ("method", "m"), ("function", "f")}),
        ("csharp", "namespace N {\nclass C {\n  public int P { get; set; }\n  public void M() { }\n}\n}\n", {("module", "N"), ("class", "C"), ("method", "P"), ("method", "M")}),
        ("sql", "CREATE TABLE a.b (x int);\n-- create view no as\ncreate or replace view v as select 1;\n", {("table", "a.b"), ("view", "v")}),
    ],
)
def test_scanners(language, code, want):
    assert {(c.kind, c.name) for c in chunking.chunk_file(code.encode(), language)} == want


def test_enumeration(spark, tmp_path):
    (tmp_path / "src/gen").mkdir(parents=True)
    for name, text in {"src/keep.rs": "fn a() {}", "src/gen/gen.rs": "fn b() {}", "skip.rs": "x", "again.rs": "y", ".gitignore": "skip.rs\n", ".indexignore": "again.rs\n", ".indexinclude": "again.rs\n", "src/gen/.indexignore": "*.rs\n"}.items():
        (tmp_path / name).write_text(text)
    rows = {r.rel_path: (r.language, r.force_indexed) for r in files.enumerate_files(spark, str(tmp_path)).collect()}
    assert rows == {"src/keep.rs": ("rust", False), "again.rs": ("rust", True)}
    r = files.Rules(["/a", "b/", "*.log", "!keep.log", "x/**/y", "[ab].txt"])
    assert [r.matches(p) for p in ("a", "c/a", "b/f", "z.log", "keep.log", "x/1/2/y", "a.txt", "c.txt")] == [True, None, True, True, False, True, True, None]


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "idx"), buckets=4)
    assert s.rows().count() == 0 and not s.exists()
    row = lambda f, k: ("r", f, k, k + 1, 1, 1, k, "rust", "function", None, bytearray(16), f"body {k}", [1.0, 0.0])
    df = spark.createDataFrame([row("a", 1), row("a", 2), row("b", 3), row("c", 4)], store.CHUNKS)
    s.append(df, 2)
    assert s.count() == 4 and s.file("a").count() == 2
    s.replace(spark.createDataFrame([row("a", 9)], store.CHUNKS))
    assert sorted(values(s.rows(), "chunk_id")) == [3, 4, 9]
    s.delete(spark.createDataFrame([("b",)], "file_path string"))
    assert sorted(values(s.rows(), "chunk_id")) == [4, 9] and sorted(values(s.files(), "file_path")) == ["a", "c"]
    s.note(spark.createDataFrame([("empty", bytearray(b"h")), ("c", bytearray(b"n"))], store.FILES))
    assert values(s.rows(), "chunk_id") == [9] and sorted(values(s.files(), "file_path")) == ["a", "c", "empty"]
    s.append(spark.createDataFrame([row("c", 4)], store.CHUNKS), 2)
    m = s.sync(store.Manifest("stub", 2), "2024-01-01T00:00:00Z")
    assert s.manifest() == m and m.chunk_count == 2 and s.in_step()
    s.set_floor(0.5)
    assert s.manifest().similarity_floor == 0.5
    now = "2024-02-01T00:00:00Z"
    assert s.touch(s.files(), "other", 2, now) is None and s.touch(s.files().limit(1), "stub", 2, now) is None
    assert s.touch(s.files(), "stub", 2, now).last_full_index_at == now and s.manifest().chunk_count == 2
    with pytest.raises(Exception, match="finite"):
        s.append(spark.createDataFrame([row("z", 1)], store.CHUNKS).withColumn("vector", F.array(F.lit(float("nan")), F.lit(0.0)).cast("array<float>")), 2)
    assert s.count() == 2
    s.delete(s.paths())
    assert s.manifest().chunk_count == 0 and s.rows().count() == 0
    s.append(df, 2)
    s.clear()
    assert s.manifest().chunk_count == 0 and s.count() == 0 and s.files().count() == 0 and s.manifest().similarity_floor is None
    for error, args in ((store.ModelMismatch, ("other", 2)), (store.WidthMismatch, ("stub", 3))):
        with pytest.raises(error):
            m.check(*args)


def test_providers(spark):
    class Down(embedding.Stub):
        def embed(self, batch):
            raise embedding.Unavailable("down")

    both = embedding.Fallback(Down(), embedding.Stub())
    assert both.embed(["a"]) == embedding.Stub().embed(["a"])
    df = spark.createDataFrame([("a",), (None,)], "t string").select(embedding.embed(F.col("t"), embedding.Stub(4)).alias("v"))
    assert [len(r.v) for r in df.collect()] == [4, 4]
    with pytest.raises(embedding.BadReply):
        embedding.in_order([{"index": 0, "embedding": [1]}, {"index": 0, "embedding": [1]}], 2, 1)
    assert embedding.sub_batches([1000, 10, 1000, 10], 2048) == [[1, 3], [0, 2]]


def test_queue(spark):
    lines = spark.createDataFrame([("1\ta\ts",), ("x\ta",), ("5\ta",), ("9\tb\t",), ("2",)], "value string")
    q = queue.parse(lines)
    assert sorted((r.ts, r.path, r.session) for r in q.collect()) == [(1, "a", "s"), (5, "a", None), (9, "b", None)]
    d = {r.path: r.deadline for r in queue.deadlines(q, 10, 12).collect()}
    assert d == {"a": 13, "b": 19}


def test_streamed_debounce_cap(spark, tmp_path):
    stamps = [f"2024-01-01 00:00:{s:02d}" for s in range(0, 60, 5)] + ["2024-01-01 00:10:00"]
    spark.createDataFrame([(f"{s}", "p") for s in stamps], "s string, path string").select(F.to_timestamp("s").alias("ts"), "path").coalesce(1).write.parquet(str(tmp_path / "in"))
    out = state.debounced(spark.readStream.schema("ts timestamp, path string").parquet(str(tmp_path / "in")), 10_000, 20_000)
    query = out.writeStream.format("memory").queryName("debounce").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = sorted((r.first_seen, r.edits) for r in spark.table("debounce").collect())
    assert [n for _, n in rows][:3] == [4, 4, 4]


def test_evaluation():
    assert evaluation.spread(10, 3) == [0, 4, 5, 9] and evaluation.spread(5, 1) == [2] and evaluation.spread(0, 3) == []


def _run(out, at, name):
    """What a streaming plan gives of all that is there, kept at one checkpoint."""
    query = out.writeStream.format("parquet").option("path", f"{at}/{name}").option("checkpointLocation", f"{at}/{name}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _moved(at, k):
    """The k-th part lands in the folder that is streamed."""
    os.makedirs(f"{at}/all", exist_ok=True)
    for f in os.listdir(f"{at}/in{k}"):
        if f.endswith(".parquet"):
            os.rename(f"{at}/in{k}/{f}", f"{at}/all/{k}-{f}")


def _files(spark, at, schema, *parts):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{at}/in{k}")


def test_session_state_outlives_a_restart(spark, tmp_path):
    """Three runs on one checkpoint: what was shown before stays known, until the session starts anew."""
    at, schema = str(tmp_path), "session string, seq long, start boolean, file_path string, name string, line_start long, line_end long"
    _files(
        spark, at, schema,
        [("s", 1, None, "a.py", "f", 1, 20), ("t", 2, False, "a.py", None, 1, 5), ("s", 3, False, "b.py", "f", 1, 20), ("s", 4, False, "a.py", "f", 2, 3)],
        [("s", 5, False, "a.py", "f", 5, 20), ("t", 6, False, "a.py", "f", 1, 5), ("s", 7, False, "a.py", "f", 5, 21), ("t", 8, False, "a.py", None, 1, 5)],
        [("s", 9, True, None, None, None, None), ("s", 10, False, "a.py", "f", 5, 20), ("t", 11, False, "a.py", "f", 1, 4), ("s", 12, True, "b.py", "f", 2, 3), ("s", 13, False, "a.py", "f", 5, 20)],
    )
    shown = [{("s", "a.py", "f", 1, 20), ("t", "a.py", None, 1, 5), ("s", "b.py", "f", 1, 20)}, {("t", "a.py", "f", 1, 5), ("s", "a.py", "f", 5, 21)}, {("s", "b.py", "f", 2, 3), ("s", "a.py", "f", 5, 20)}]
    for k in range(3):
        _moved(at, k)
        query = _run(state.suppressed(spark.readStream.schema(schema).parquet(f"{at}/all"), None), at, "hints")
        assert query.lastProgress["stateOperators"][0]["operatorName"].startswith("transformWithState")
        now = [tuple(r) for r in spark.read.parquet(f"{at}/hints").collect()]
        assert len(now) == len(set(now)) + (k == 2) and set(now) == set().union(*shown[: k + 1])


def test_debounce_and_windows_outlive_a_restart(spark, tmp_path):
    """A round, and a watcher's window, that a first run leaves open goes on in the second."""
    at, schema = str(tmp_path), "repo string, path string, ms long"
    _files(spark, at, schema, [("r", "a", 1000), ("r", "b", 1100), ("r", "a", 1249), ("q", "z", 90)], [("r", "c", 1240), ("r", "b", 1250), ("r", "a", 9000), ("r", "a", 400_000)])
    for k in range(2):
        _moved(at, k)
        edits = spark.readStream.schema(schema).parquet(f"{at}/all").select("repo", "path", F.timestamp_millis("ms").alias("ts"))
        _run(state.debounced(edits), at, "rounds")
        _run(state.windows(edits, late="1 minute"), at, "windows")
        if k == 0:
            assert spark.read.schema("path string").parquet(f"{at}/rounds").count() == 0 and spark.read.schema("path string").parquet(f"{at}/windows").count() == 0
    assert {tuple(r) for r in spark.read.parquet(f"{at}/rounds").collect()} == {("a", 1000, 9000, 3), ("b", 1100, 1250, 2), ("c", 1240, 1240, 1), ("z", 90, 90, 1)}
    assert {tuple(r) for r in spark.read.parquet(f"{at}/windows").collect()} == {("r", 1000, 0, "a", 2), ("r", 1000, 1, "b", 1), ("r", 1000, 2, "c", 1), ("r", 1250, 0, "b", 1), ("r", 9000, 0, "a", 1), ("q", 90, 0, "z", 1)}


def test_read_windows(spark, tmp_path):
    at, schema = str(tmp_path), "session string, seq long, start boolean, file_path string, offset long, `limit` long"
    rows = [("s", 1, False, "a", None, None), ("s", 2, False, "a", 10, 50), ("s", 3, False, "a", 1990, 20), ("s", 4, False, "a", 5, 0), ("s", 5, False, "b", 0, 1), ("s", 6, True, None, None, 0), ("s", 7, False, "a", 10, 50), ("s", 8, False, "a", 1, 9000), ("s", 9, False, "a", 11, 2)]
    _files(spark, at, schema, rows)
    _run(state.read_windows(spark.readStream.schema(schema).parquet(f"{at}/in0"), None), at, "reads")
    assert {tuple(r) for r in spark.read.parquet(f"{at}/reads").collect()} == {("s", "a", 1, 2000), ("s", "a", 1990, 2009), ("s", "b", 1, 1), ("s", "a", 10, 59)}


def _clusters(spark, n, centres, width=16, spread=0.05, seed=4):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, width))
    x = c[np.arange(n) % centres] + spread * rng.normal(size=(n, width))
    rows = [("r" if k % 3 else None, f"f{k % 11}", k, [float(v) for v in x[k]]) for k in range(n)]
    return x / np.linalg.norm(x, axis=1, keepdims=True), spark.createDataFrame(rows, "repo string, file_path string, chunk_id long, vector array<double>")


def test_blocks_that_cannot_reach_are_skipped(spark, monkeypatch):
    """Of clustered vectors nearly all pairs of blocks are skipped, and no pair of vectors is lost."""
    monkeypatch.setattr(blocks, "BLOCK", 32)
    u, df = _clusters(spark, 1600, 40)
    own = blocks.pack(df, ["repo", "file_path", "chunk_id"], blocks.pivots(df, blocks.PIVOTS), 16)
    homes, guests = similarity.block_pairs(own, 0.9)
    n = len(own.numbers)
    assert n >= 40 and len(homes) < 0.35 * n * (n + 1) / 2
    # a block visits where it has to, and nowhere else; homes share the work
    assert np.bincount(homes).max() <= n * 0.75
    sim = u @ u.T
    i, j = np.nonzero(np.triu(sim >= 0.9, 1))
    want = {(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if a % 11 != b % 11 or (a % 3 == 0) != (b % 3 == 0)}
    got = similarity.duplicate_pairs(df, 0.9, None).collect()
    assert {tuple(sorted((r.a_chunk, r.b_chunk))) for r in got} == want and len(got) == len(want)
    best = similarity.duplicate_pairs(df, 0.9, 25)
    plan = best._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "Generate" not in plan
    every = sorted(((-round(r.similarity, 6), r.a_repo is not None, r.a_repo, r.a_file, r.a_chunk, r.b_repo is not None, r.b_repo, r.b_file, r.b_chunk) for r in got), key=str)
    assert [-round(r.similarity, 6) for r in best.collect()] == sorted(x[0] for x in every)[:25]


def test_equal_vectors_fill_a_block_and_the_best_are_whole(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 16)
    rows = [("r", f"f{k:03d}", k, [1.0, 2.0]) for k in range(100)] + [("r", "z", 500, [-1.0, 2.0]), ("r", "z", 501, None), ("r", "z", 502, [0.0, 0.0]), ("r", "z", 503, [1.0])]
    df = spark.createDataFrame(rows, "repo string, file_path string, chunk_id long, vector array<double>")
    got = [(r.a_chunk, r.b_chunk) for r in similarity.duplicate_pairs(df, 0.99, 60).collect()]
    assert got == [(a, b) for a in range(100) for b in range(a + 1, 100)][:60]


def test_many_edits_are_one_plan(spark, monkeypatch):
    """Ten thousand edits meet the corpus in one plan, whose size does not follow their number."""
    u, df = _clusters(spark, 400, 20)
    rng = np.random.default_rng(6)
    picked = rng.integers(0, 400, 10_000)
    rows = [(k, f"f{i % 11}", [float(v) for v in u[i]]) for k, i in enumerate(picked.tolist())]
    edits = spark.createDataFrame(rows, "edit long, own string, vector array<double>")
    out = similarity.scores(df, edits, 0.5, top=3)
    size = lambda f: f._jdf.queryExecution().analyzed().toString().count("\n")
    assert size(out) == size(similarity.scores(df, edits.limit(5), 0.5, top=3)) and "MapInArrow" in out._jdf.queryExecution().toString()
    pools = evaluation.pool(out, 0.5).where("rank <= 3").collect()
    sim = np.maximum(u[picked[:200]] @ u.T, 0)
    for k in range(200):
        best = {}
        for c, s in enumerate(sim[k].tolist()):
            if c % 11 != picked[k] % 11:
                best[f"f{c % 11}"] = max(best.get(f"f{c % 11}", 0), round(s, 6))
        want = sorted((f for f in best if best[f] >= 0.5), key=lambda f: (-best[f], f))[:3]
        assert [r.file_path for r in sorted((r for r in pools if r.edit == k), key=lambda r: r.rank)] == want


def test_places_and_values_at_a_rank(spark):
    """Ties, equal rows, signs, extremes and one value over and over."""
    rng = random.Random(7)
    odd = [0.0, -0.0, 1e-300, -1e-300, 1e300, -1e300, float("inf"), float("-inf"), 5e-324]
    for xs in ([0.25] * 700, odd * 3 + [rng.gauss(0, 1) for _ in range(500)], [rng.choice([0.1, 0.2, 0.3]) for _ in range(400)] + [None] * 9, [7.5]):
        df = spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "k int, v double").repartition(5)
        whole = sorted(x for x in xs if x is not None)
        percents = [1, 10, 33, 50, 90, 99, 100]
        got = {r.p: r.value for r in ranks.nearest_rank(df, "v", percents).collect()}
        assert got == {p: whole[max(1, -(-len(whole) * p // 100)) - 1] for p in percents}
        at = {r.k: r.place for r in ranks.placed(df.where("v is not null"), [F.desc("v"), "k"], "place").collect()}
        assert at == {k: i for i, (k, _) in enumerate(sorted(((k, x) for k, x in enumerate(xs) if x is not None), key=lambda r: (-r[1], r[0])))}
    none = spark.createDataFrame([(None,)], "v double")
    assert ranks.nearest_rank(none, "v", [50]).count() == 0 and ranks.placed(none.limit(0), ["v"], "place").count() == 0
    big = spark.createDataFrame([(v,) for v in (-(1 << 63), -1, 0, 1, (1 << 63) - 1)], "v long")
    assert {r.p: r.value for r in ranks.nearest_rank(big, "v", [1, 40, 100]).collect()} == {1: -(1 << 63), 40: -1, 100: (1 << 63) - 1}


def test_seeds_take_every_stride_th_file(spark):
    rows = [(f"f{k // 3:02d}", k, [1.0, float(k)]) for k in range(90)]
    df = spark.createDataFrame(rows, "file_path string, chunk_id long, vector array<double>")
    got = sorted((r.file_path, r.chunk_id) for r in similarity.seeds(df, 7).collect())
    assert got == [(f"f{f:02d}", 3 * f + 1) for f in range(0, 30, 5)]


def test_visits_follow_the_rows_and_not_the_pairs(spark, monkeypatch):
    """However many blocks there are, a block goes to each group of homes once at most, and all pairs meet."""
    monkeypatch.setattr(blocks, "BLOCK", 8)
    monkeypatch.setattr(blocks, "GROUPS", 4)
    u, df = _clusters(spark, 480, 40)
    own = blocks.pack(df, ["repo", "file_path", "chunk_id"], blocks.pivots(df, 4), 16)
    homes, guests = similarity.block_pairs(own, -1.0)
    n = len(own.numbers)
    _, visits = blocks.visited(own, homes, guests)
    rows = visits.collect()
    assert n >= 40 and len(homes) == n * (n + 1) / 2 and len(rows) <= 4 * n and sum(len(r.meets) for r in rows) == len(homes)
    sim = u @ u.T
    i, j = np.nonzero(np.triu(sim >= 0.5, 1))
    want = {(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if a % 11 != b % 11 or (a % 3 == 0) != (b % 3 == 0)}
    got = similarity.duplicate_pairs(df, 0.5, None).collect()
    assert {tuple(sorted((r.a_chunk, r.b_chunk))) for r in got} == want and len(got) == len(want)
    best = [tuple(r) for r in similarity.duplicate_pairs(df, 0.5, 30).collect()]
    assert best == [tuple(r) for r in got[:30]]


def test_chunks_are_made_in_batches_of_bounded_bytes(spark):
    from lodestone import scratch
    from lodestone.operators import chunking

    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
        body = b"".join(b"line %d\n" % k for k in range(3000))
        files = spark.createDataFrame([("r", f"f{k}", "unknown", b"h", True, body * 40) for k in range(6)], "repo string, rel_path string, language string, file_hash binary, force_indexed boolean, content binary")
        out = chunking.chunks(files, overlap=0)
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == scratch.BATCH_ROWS
        # of several batches of a file's chunks none is lost
        assert [r.n for r in out.groupBy("file_path").agg(F.sum(F.octet_length("content")).alias("n")).collect()] == [len(body) * 40] * 6
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_a_rewrite_exchanges_no_chunk_to_find_its_own(spark, tmp_path, monkeypatch):
    """Few touched paths go to the chunks, whatever Spark thinks of their size."""
    from lodestone import queries

    plans, plain = [], store.delete_paths

    def seen(table, paths):
        out = plain(table, paths)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(store, "delete_paths", seen)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows, own = queries.document_chunks(spark, "/root/testdata/sf0.001").limit(200), store.Store(spark, str(tmp_path / "s"), 2)
        own.append(rows, 2)
        own.delete(rows.where("chunk_id % 97 = 3").select("file_path"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert plans and all("BroadcastHashJoin" in p and "SortMergeJoin" not in p for p in plans)
