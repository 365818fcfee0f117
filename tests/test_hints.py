"""Events, ledgers, search commands and hints."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import commands, embedding
from lodestone.functions import text as X
from lodestone.operators import chunking, evaluation, hints
from lodestone.operators import similarity
from lodestone.sources import ledgers


COMMANDS = [
    ("rg foo", "foo"), ("grep -n 'two words'", "two words"), ("git grep foo", "foo"), ("git log foo", None), ("ls foo", None),
    ("time nice rg foo", "foo"), ("stdbuf -oL -eL rg foo", "foo"), ("stdbuf rg foo", "foo"), ("env A=1 B=2 ag foo", "foo"), ("env", None),
    ("rg foo src", None), ("rg -l foo", None), ("rg -nv foo", None), ("rg --count foo", None), ("rg --json foo", None),
    ("rg -e foo", "foo"), ("rg -efoo", None), ("rg -emain", "main"), ("rg -e foo -e bar", None), ("rg --regexp=foo", "foo"), ("rg --regexp foo", "foo"), ("rg --regexp", None),
    ("rg -t py foo", "foo"), ("rg --glob '*.py' foo", "foo"), ("rg --type=py foo", "foo"), ("rg -- -foo", "-foo"), ("rg --hidden foo", "foo"),
    ("rg 'unclosed", None), ("", None), (None, None), ("rg", None), ("rg -", "-"), ("rg -e", None), ("rg -i foo", "foo"),
]
#: Quotes and escapes, where they end and where not, and options that the list above has not.
COMMANDS += [
    ('rg "two words"', "two words"), ("rg 'it'\"'s\"", "it's"), ("rg two\\ words", "two words"), ('rg "open', None), ("rg foo | head", None), ("  rg   foo  ", "foo"), ("rgx foo", None), ("ripgrep -T md -g '*.rs' foo", "foo"), ("env A=1 time rg foo", "foo"),
    ("git  grep -e foo", "foo"), ("rg --type", None), ("rg -A 3 foo", None), ("rg -- foo bar", None), ("rg ''", ""), ("rg --color never --sort path foo", "foo"), ("rg -e -x", "-x"),
]


def test_search_commands(spark):
    df = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(COMMANDS)], "k int, c string").select("k", commands.searched(F.col("c")).alias("p"))
    assert [(COMMANDS[r.k][0], r.p) for r in sorted(df.collect())] == COMMANDS
    assert "Python" not in df._jdf.queryExecution().toString()


def test_command_column(spark):
    df = spark.createDataFrame([("rg foo",), (None,), ("ls",)], "c string")
    assert [r[0] for r in df.select(commands.searched(F.col("c"))).collect()] == ["foo", None, None]
    df = spark.createDataFrame([('{"pattern": "x"}',), ('{"pattern": "x", "-A": 2}',), ('{"path": "src"}',), (None,)], "p string")
    assert [r[0] for r in df.select(commands.scoped(F.col("p"))).collect()] == [False, True, True, False]


def test_which_events_change_files(spark):
    rows = [
        ("Write", None, True), ("Edit", '{"structuredPatch": []}', False), ("Edit", '{"structuredPatch": [1]}', True), ("Edit", "{}", True), ("Write", '{"structuredPatch": []}', True),
        ("Edit", '{"is_error": true}', False), ("Edit", '{"success": false}', False), ("Write", '{"error": "x"}', False), ("Write", '{"error": null}', True), ("Write", "not json", True), ("Read", None, None),
    ]
    df = spark.createDataFrame([(k, t, r) for k, (t, r, _) in enumerate(rows)], "k int, tool string, response string")
    assert {r.k for r in hints.edit_events(df).collect()} == {k for k, (_, _, want) in enumerate(rows) if want}
    events = spark.createDataFrame([("s", "Write", None, "a.py", None, None), (None, "MultiEdit", None, "b.py", "b.py", ["c.py", "b.py", ""])], "session string, tool string, response string, file_path string, notebook_path string, files_modified array<string>")
    got = hints.enqueued(events, F.col("path") != "c.py", F.lit(7)).collect()
    assert {(r.ts, r.path, r.session) for r in got} == {(7, "a.py", "s"), (7, "b.py", None)} and len(got) == 2


def test_related_hints(spark):
    near = [("s", "e.py", f, n, a, b, x) for f, n, a, b, x in [("a.py", "f", 1, 9, 0.91), ("b.py", None, 5, 6, 0.9), ("e.py", "own", 1, 2, 0.99), ("gone.py", "g", 1, 2, 0.95), ("../x.py", "x", 1, 2, 0.95), ("seen.py", "h", 3, 4, 0.95), ("read.py", "i", 3, 4, 0.95), ("README.md", None, 1, 3, 0.85), ("c.py", "z", 1, 2, 0.1)]]
    near = spark.createDataFrame(near, "session string, edited_path string, file_path string, name string, line_start long, line_end long, score double")
    seen = spark.createDataFrame([("s", "seen.py", "h", 1, 9), ("s", "a.py", "other", 1, 9), ("t", "b.py", None, 1, 9)], "session string, file_path string, name string, line_start long, line_end long")
    read = spark.createDataFrame([("s", "read.py", 1, 100), ("s", "a.py", 2, 100)], "session string, file_path string, line_start long, line_end long")
    files = spark.createDataFrame([(f,) for f in ("a.py", "b.py", "e.py", "seen.py", "read.py", "README.md", "c.py", "../x.py")], "file_path string")
    shown = hints.fresh(near, seen, read, files, 3)
    assert [(r.rank, r.file_path, r.is_doc) for r in shown.orderBy("rank").collect()] == [(1, "a.py", False), (2, "b.py", False), (3, "README.md", True)]
    assert hints.contexts(shown).first().context == "related code: a.py:1-9 `f`  (0.91); b.py:5-6  (0.90)\nrelated docs: README.md:1-3  (0.85)"
    assert hints.contexts(shown.where("is_doc"), " ").first().context == "related docs: README.md:1-3 (0.85)"
    markers = spark.createDataFrame([("s", 1), (None, 2), ("t", 3)], "session string, k int")
    events = spark.createDataFrame([("s",), (None,)], "session string")
    assert [r.k for r in hints.attributed(markers, events).collect()] == [1]
    both = spark.createDataFrame([("s", 2, "b"), ("s", 1, "a"), ("t", 1, "c"), ("t", 2, None)], "session string, ord int, context string")
    assert {r.session: r.context for r in hints.merged(both).collect()} == {"s": "a\nb", "t": "c"}
    one = spark.range(1).select(hints.compact_json(F.lit("x").alias("a"), F.lit(None).cast("string").alias("b"), hints.true_only(F.lit(False)).alias("c"), hints.true_only(F.lit(True)).alias("d")))
    assert one.first()[0] == '{"a":"x","d":true}'


def test_ledgers(spark, tmp_path):
    path = str(tmp_path / "seen")
    assert ledgers.read_ledger(spark, path).count() == 0
    rows = spark.createDataFrame([("a.py", "f", 1, 2), ("b.py", None, 3, 4), ("c\t.py", "g", 1, 2), ("d.py", "x\ny", 1, 2)], ledgers.SEEN)
    ledgers.append_ledger(rows, path)
    ledgers.append_ledger(rows.limit(1), path)
    assert sorted(map(tuple, ledgers.read_ledger(spark, path).collect())) == [("a.py", "f", 1, 2), ("a.py", "f", 1, 2), ("b.py", None, 3, 4)]
    bad = spark.createDataFrame([("a\t1\t2",), ("a\t1",), ("a\tx\t2",), ("a\t1\t2\t3",)], "value string")
    assert [tuple(r) for r in ledgers.parse_ledger(bad, ledgers.READ).collect()] == [("a", 1, 2)]
    marker = str(tmp_path / "deep/marker.json")
    assert ledgers.read_marker(marker) is None and ledgers.read_marker(marker, remove=True) is None
    ledgers.write_marker(marker, {"a": 1})
    ledgers.write_marker(marker, {"a": 2})
    assert ledgers.read_marker(marker) == {"a": 2} and ledgers.read_marker(marker, remove=True) == {"a": 2} and ledgers.read_marker(marker) is None
    log = "total 9 pid 1\nindexed a\ntotal 5 pid 7\nindexed a\nskipped b x\nnoise\nverified c\n"
    assert ledgers.progress(log, 7) == (3, 5) and ledgers.progress(log, 1) == (0, None) and ledgers.progress("", 7) == (0, None) and ledgers.progress("total 5 pid 7 x", 7) == (0, None)
    assert ledgers.last_error_line("error: a\nok\nerror: b\n") == "error: b" and ledgers.last_error_line("fine") is None


def test_targets_and_symbols(spark):
    df = spark.createDataFrame([("look in a.hxx",), ("see x.c",), ("notes.md here",), ("--glob x",), ("plain words",)], "t string")
    assert [r[0] for r in df.select(X.looks_like_target(F.col("t"))).collect()] == [True, True, False, True, False]
    df = spark.createDataFrame([("abc",), ("abcd",), ("default",), ("éé",), (None,)], "s string")
    assert [r[0] for r in df.select(X.evaluable(F.col("s"))).collect()] == [False, True, False, True, None]


def test_model_pieces():
    import numpy as np

    tokens, mask = embedding.padded([[5, 6], [7]])
    assert tokens.tolist() == [[5, 6], [7, 0]] and mask.tolist() == [[1, 1], [1, 0]]
    hidden = np.array([[[3.0, 4.0], [0.0, 2.0]], [[0.0, 0.0], [9.0, 9.0]]])
    assert np.allclose(embedding.pooled(hidden, mask, "cls"), [[0.6, 0.8], [0, 0]])
    mean = np.array([1.5, 3.0]) / np.hypot(1.5, 3.0)
    assert np.allclose(embedding.pooled(hidden, mask, "mean"), [mean, [0, 0]])
    with pytest.raises(embedding.BadReply):
        embedding.checked_output(hidden, 2, 3)
    with pytest.raises(ValueError):
        embedding.pooled(hidden, mask, "max")


def test_verified_assets(tmp_path):
    import hashlib

    p = tmp_path / "asset"
    p.write_bytes(b"abc")
    digest = hashlib.sha256(b"abc").hexdigest()
    assert embedding.verified(str(p), 3, digest) and not embedding.verified(str(p), 4, digest) and not embedding.verified(str(p), 3, "0" * 64) and not embedding.verified(str(tmp_path / "no"), 3, digest)


def test_empty_and_null_vectors(spark):
    df = spark.createDataFrame([(f"f{k}", k, None if k == 1 else [1.0, float(k)]) for k in range(4)], "file_path string, chunk_id long, vector array<double>")
    assert {r.score for r in similarity.best_of_queries(df, []).collect()} == {0.0}
    assert {r.file_path for r in similarity.best_neighbours(df).collect()} == {"f0", "f2", "f3"}
    assert similarity.best_neighbours(df.limit(0)).count() == 0 and similarity.best_neighbours(df.where("chunk_id = 1")).count() == 0
    edits = spark.createDataFrame([(0, "f0", [1.0, 0.0]), (1, "f2", None), (2, "f3", [0.0, 0.0])], "edit long, own string, vector array<double>")
    got = {(r.edit, r.file_path) for r in similarity.scores(df, edits).collect()}
    assert got == {(0, "f1"), (0, "f2"), (0, "f3")} and similarity.scores(df, edits.limit(0)).count() == 0
    ranked = spark.createDataFrame([(v,) for v in (1, 1, 2, 3, 3, 3, 9, 9, 9, 10)], "v int")
    assert {r.p: r.value for r in similarity.nearest_rank(ranked, "v", [1, 20, 21, 60, 61, 100]).collect()} == {1: 1, 20: 1, 21: 2, 60: 3, 61: 9, 100: 10}


def test_edits_and_replay(spark):
    rows = [("a", k, [float(k), 1.0]) for k in range(5)] + [("b", 9, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "file_path string, chunk_id long, vector array<double>")
    own = lambda how: sorted((r.own, r.vector[0]) for r in evaluation.edits(df, how).collect())
    assert own("median") == [("a", 2.0), ("b", 1.0)] and len(own("whole")) == 6 and own(3) == [("a", 0.0), ("a", 2.0), ("a", 4.0), ("b", 1.0)]
    pools = spark.createDataFrame([(e, f, k + 1) for e, fs in enumerate(["xyz", "xyz", "xy", "x"]) for k, f in enumerate(fs)], "edit long, file_path string, rank int")
    stats = evaluation.replay_stats(evaluation.replay(pools, 1, 1), 5).first()
    # edit 0 shows x; 1 is silent and y, z lie beyond its depth; so for 2; 3 has nothing new
    assert (stats.emitted, stats.silent, stats.starved, stats.repeated_lists, stats.files, stats.hub) == (1, 4, 2, 0, 1, "x")
    stats = evaluation.replay_stats(evaluation.replay(pools, None, 2, dedup=False), 4).first()
    assert (stats.emitted, stats.silent, stats.starved, stats.repeated_lists) == (7, 0, 0, 2)


def test_code_identifiers():
    assert evaluation.code_identifiers("def f(x):  # gone\n    return 'gone' + y\n", "python") == {"f", "x", "y"}
    assert {"f", "y"} <= evaluation.code_identifiers('fn f() { /* gone */ let y = "gone"; }', "rust") and "gone" not in evaluation.code_identifiers('fn f() { /* gone */ let y = "gone"; }', "rust")
    assert evaluation.code_identifiers("x", "unknown") is None


def test_decorated_and_bodies():
    own = lambda code, language: [(c.kind, c.name, code[c.start : c.end]) for c in chunking.chunk_file(code, language)]
    assert [x[:2] for x in own(b"@d\nclass C:\n    def m(self): pass\n", "python")] == [("function", "m")]
    assert own(b"@ d\ndef f(): pass\n", "python")[0] == ("function", None, b"@ d\ndef f(): pass")
    body = b"create function f() returns int as $$ begin x := 1; return x; end; $$ language plpgsql;"
    assert own(body + b"\ncreate table t (x int);", "sql") == [("function", "f", body), ("table", "t", b"create table t (x int);")]
