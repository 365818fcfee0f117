"""The verbs of an index over small projects."""

import struct

import pytest

from lodestone import config as K
from lodestone import engine as E
from lodestone.functions import embedding
from lodestone.operators import store as S
from lodestone.sources import files as files_


def project(path, files):
    (path / ".git/objects").mkdir(parents=True)
    (path / ".git/HEAD").write_text("ref: refs/heads/main\n")
    for name, text in files.items():
        (path / name).parent.mkdir(parents=True, exist_ok=True)
        (path / name).write_text(text)
    return path


def settings(**more):
    return K.build(K.Config, K.merge({"embedding": {"model": "stub", "dimensions": 8}}, more))


FILES = {
    "src/alpha.py": "def alpha_one():\n    return 'hent'\n\n\ndef alpha_two(x):\n    return x + 1\n",
    "src/beta.py": "class Beta:\n    def hest(self):\n        return 2\n",
    "src/empty.py": "# nothing here\n",
    "notes.xyz": "plain words, which no chunker reads\n",
    "skip.py": "def skipped():\n    pass\n",
    ".gitignore": "skip.py\n",
}


def engine(spark, root, **more):
    return E.Engine(spark, str(root), settings(**more), buckets=4)


def test_index_life(spark, tmp_path):
    root = project(tmp_path / "p", FILES)
    e = engine(spark, root)
    assert e.status()["present"] is False and e.status()["due"]
    said = []
    first = e.index("2024-01-01T00:00:00Z", lambda what, n: said.append(what))
    assert (first.file_count, first.chunk_count, first.warning) == (2, 4, None) and said == ["enumerated", "changed", "indexed"]
    assert {r.file_path for r in e.store.files().collect()} == {"src/alpha.py", "src/beta.py", "src/empty.py", "notes.xyz"}
    before = {r.chunk_id for r in e.store.rows().collect()}
    # nothing changed: only the times do
    said.clear()
    again = e.index("2024-01-02T00:00:00Z", lambda what, n: said.append(what))
    assert again == first and said == ["enumerated"] and e.store.manifest().last_full_index_at == "2024-01-02T00:00:00Z"
    # one file changes, one goes, one comes
    (root / "src/alpha.py").write_text("def alpha_three():\n    return 3\n")
    (root / "src/beta.py").unlink()
    (root / "src/gamma.py").write_text("def gamma():\n    pass\n")
    third = e.index("2024-01-03T00:00:00Z")
    names = {(r.file_path, r.name) for r in e.store.rows().collect()}
    assert third.chunk_count == 2 and names == {("src/alpha.py", "alpha_three"), ("src/gamma.py", "gamma")} and not before & {r.chunk_id for r in e.store.rows().collect()}
    assert e.status("2024-01-03T01:00:00Z")["due"] is False and e.status("2024-01-03T01:00:00Z")["updated_ago"] == "1h0m"
    assert e.status("2024-01-09T00:00:00Z")["due"] is True
    # a table that does not hold what the manifest claims is built again
    e.store.delete(spark.createDataFrame([("src/gamma.py",)], "file_path string"))
    e.store.write_manifest(S.replace(e.store.manifest(), chunk_count=7))
    assert e.index().chunk_count == 2
    e.clear()
    assert e.stats() == E.Stats() and e.store.rows().count() == 0
    assert e.index().chunk_count == 2


def test_one_file(spark, tmp_path):
    root = project(tmp_path / "p", FILES)
    e = engine(spark, root)
    e.index()
    assert e.reindex_file("src/beta.py") == e.stats()
    (root / "src/beta.py").write_text("def beta():\n    pass\n\n\ndef more():\n    pass\n")
    assert e.reindex_file(str(root / "src/beta.py"), "2030-01-01T00:00:00Z").chunk_count == 4
    assert e.store.manifest().last_incremental_at == "2030-01-01T00:00:00Z"
    (root / "src/beta.py").write_text("# no chunks left\n")
    assert e.reindex_file("src/beta.py").chunk_count == 2 and "src/beta.py" in {r.file_path for r in e.store.files().collect()}
    (root / "src/alpha.py").unlink()
    assert e.reindex_file("src/alpha.py").chunk_count == 0 and "src/alpha.py" not in {r.file_path for r in e.store.files().collect()}
    (root / "skip.py").write_text("def other():\n    pass\n")
    assert e.reindex(["skip.py", ".git/HEAD"]).chunk_count == 0  # ignored
    (root / "notes.xyz").unlink()
    e.prune()
    assert "notes.xyz" not in {r.file_path for r in e.store.files().collect()}
    with pytest.raises(ValueError):
        e.reindex_file("../outside.py")


def test_search(spark, tmp_path):
    root = project(tmp_path / "p", FILES)
    other = project(tmp_path / "q", {"lib/hent.py": "def hent_other():\n    return 'hent hent'\n"})
    bare = project(tmp_path / "r", {})
    (other / ".lodestone").mkdir()
    (other / ".lodestone/config.toml").write_text("[embedding]\nmodel = 'stub'\ndimensions = 8\n")
    (bare / ".lodestone").mkdir()
    (bare / ".lodestone/config.toml").write_text("[embedding]\nmodel = 'stub'\ndimensions = 8\n")
    engine(spark, other).index()
    e = engine(spark, root)
    e.index()
    found = e.search("hent", repos=[str(other), str(bare), str(tmp_path / "none"), str(root)])
    rows = found.hits.collect()
    assert {r.repo for r in rows} == {str(root), str(other)} and rows[0].name == "hent_other" and not any(r.stale for r in rows)
    assert [x for x, _ in found.repo_errors] == [str(bare), str(tmp_path / "none")] and all(m == "not indexed" for _, m in found.repo_errors)
    assert found.stale_hint is None and found.degraded_hint is None and rows[0].snippet.startswith("def hent_other")
    assert found.groups().first().directory == "lib"
    (root / "src/alpha.py").write_text("def changed():\n    pass\n")
    found = e.search("hent")
    assert found.stale_hint == E.STALE_HINT and any(r.stale for r in found.hits.collect())
    with pytest.raises(ValueError):
        e.search("  ")
    with pytest.raises(ValueError):
        e.search("x", top_k=0)
    with pytest.raises(ValueError):
        e.search("x", vector=[1.0])
    assert e.search("hent", languages=["python"], prefix="src").hits.count() > 0


def test_search_degrades(spark, tmp_path):
    root = project(tmp_path / "p", FILES)
    engine(spark, root).index()
    with pytest.raises(S.ModelMismatch):
        engine(spark, root, embedding={"model": "stub-two"})
    other = E.Engine(spark, str(root), settings(embedding={"model": "stub-two"}), validated=False, buckets=4)
    found = other.search("hent")
    assert found.degraded_hint == E.MISMATCH_HINT and [r.name for r in found.hits.collect()] == ["alpha_one"]
    assert other.doctor()["mismatch"] and not other.doctor()["healthy"]

    class Down(embedding.Stub):
        def embed(self, batch):
            raise embedding.Unavailable("down")

        def health_check(self):
            self.embed([])

    down = E.Engine(spark, str(root), settings(), Down(8), buckets=4)
    found = down.search("hent")
    assert found.degraded_hint == E.ENDPOINT_HINT and found.hits.count() == 1
    report = down.doctor()
    assert not report["healthy"] and report["error"] == "down" and not report["mismatch"]
    fine = engine(spark, root)
    assert fine.doctor()["healthy"] and fine.overview().count() == 1
    assert fine.related("src/alpha.py").count() <= 1 and fine.duplicates(0.0).count() >= 1


def test_not_a_repository(spark, tmp_path):
    with pytest.raises(E.NotARepository):
        engine(spark, tmp_path).index()


def test_tracked_files(spark, tmp_path):
    root = project(tmp_path / "p", {"a.py": "", "kept.py": "", "gone.py": "", ".gitignore": "*.py\n"})
    entries = b""
    for name in (b"gone.py", b"kept.py"):
        entry = bytes(60) + struct.pack(">H", len(name)) + name
        entries += entry + bytes(8 - len(entry) % 8)
    (root / ".git/index").write_bytes(b"DIRC" + struct.pack(">II", 2, 2) + entries)
    (root / "gone.py").unlink()
    assert files_.tracked(str(root)) == {"gone.py", "kept.py"}
    assert [tuple(r) for r in files_.tree(spark, str(root)).collect()] == [("kept.py", False)]
    entries = bytes(60) + struct.pack(">H", 7) + b"\0gone.py\0" + bytes(60) + struct.pack(">H", 7) + b"\x07kept.py\0"
    (root / ".git/index").write_bytes(b"DIRC" + struct.pack(">II", 4, 2) + entries)
    assert files_.tracked(str(root)) == {"gone.py", "kept.py"}


def test_config(tmp_path):
    a, b = tmp_path / "a.toml", tmp_path / "b.toml"
    a.write_text("watch = true\n[search]\ntop_k = 3\nmin_score = 0\n[search.hybrid_weights]\ndense = 1\n")
    b.write_text("[search]\ntop_k = 4\n")
    c = K.load(a, b, tmp_path / "none.toml")
    assert c.watch and c.search.top_k == 4 and c.search.hybrid_weights == K.HybridWeights(dense=1.0) and c.settings().dense_weight == 1.0
    bad = [
        {"embedding": {"provider": "http"}}, {"embedding": {"model": "other"}}, {"embedding": {"dimensions": 5}}, {"embedding": {"batch_size": 0}},
        {"paths": {"index_dir": "/abs"}}, {"paths": {"log_dir": "a/../../b"}}, {"indexing": {"chunk_overlap_lines": 60}},
        {"hooks": {"reindex_debounce_secs": 70}}, {"hooks": {"related_min_similarity": 1.5}}, {"search": {"cross_repos": [" "]}},
        {"search": {"identifier_boost": float("nan")}}, {"search": {"hybrid_weights": {"dense": 0, "bm25": 0, "rrf": 0}}},
        {"search": {"hybrid_weights": {"dense": -1}}}, {"search": {"top_k": "x"}}, {"search": 3}, {"watch": 1},
    ]
    for table in bad:
        with pytest.raises(K.ConfigError):
            K.validate(K.build(K.Config, table))
    a.write_text("not toml")
    with pytest.raises(K.ConfigError):
        K.load(a)
    assert K.repositories(["a", "b"], ["b", "c", "a"]) == ["a", "b", "c"]
    for args in ((2.0, 1), (0.5, 0), (float("nan"), 1)):
        with pytest.raises(ValueError):
            K.check_duplicates(*args)


def test_provider_choice():
    c = lambda **e: K.build(K.Config, {"embedding": e})
    assert isinstance(E.provider_of(c(model="stub", dimensions=3)), embedding.Stub)
    assert isinstance(E.provider_of(c()), embedding.Model)
    http = {"provider": "http", "endpoint": " http://localhost:1/ "}
    assert isinstance(E.provider_of(c(**http), assets="/models"), embedding.Fallback)
    assert isinstance(E.provider_of(c(**http, model="other", dimensions=5), assets="/models"), embedding.Http)
    assert E.cached_provider(c()) is E.cached_provider(c()) is not E.cached_provider(c(batch_size=1))
    assert embedding.endpoint(" http://x// ") == "http://x"
    with pytest.raises(embedding.Unavailable):
        embedding.Model("none", 4, folder="/nowhere").embed(["a"])


def chunk_row(path, chunk_id, text="x", vector=(1.0, 2.0)):
    return ("r", path, 0, 1, 1, 1, chunk_id, "python", "function", None, bytearray(b"h"), text, list(vector))


def test_one_edit_is_one_bucket(spark, tmp_path, monkeypatch):
    s = S.Store(spark, str(tmp_path / "s"), 16)
    s.write_manifest(S.Manifest("stub", 2))
    s.append(spark.createDataFrame([chunk_row(f"f{k}", k) for k in range(200)], S.CHUNKS), 2)
    s.note(spark.createDataFrame([("empty", bytearray(b"e"))], S.FILES))
    was = s._state()
    read = []
    for name in ("_read", "_hashes"):
        monkeypatch.setattr(S.Store, name, lambda self, *a, f=getattr(S.Store, name): read.append(out := f(self, *a)) or out)
    s.replace(spark.createDataFrame([chunk_row("f7", 7), chunk_row("f7", 1007)], S.CHUNKS), 2)
    now = s._state()
    changed = {kind: {b for b in now[kind] if now[kind][b] != was[kind].get(b)} for kind in ("chunks", "files", "counts")}
    assert all(len(c) == 1 for c in changed.values()) and len({*changed["chunks"], *changed["files"]}) == 1
    [bucket] = changed["chunks"]
    # what was read lies in that bucket, and so does what was written
    files = {f for df in read for f in df.inputFiles()}
    assert files and all(f"/bucket={bucket}/" in f for f in files)
    assert all(len(list((tmp_path / "s" / d.split("/")[0]).glob("bucket=*"))) == 1 for kind in ("chunks", "files") for d in now[kind][bucket])
    assert (s.manifest().chunk_count, s.manifest().file_count) == (201, 200) and s.count() == 201 and s.files().count() == 201
    assert s.files(spark.createDataFrame([("f7",), ("none",)], "file_path string")).count() == 1


def test_readers_outlive_a_commit(spark, tmp_path):
    s = S.Store(spark, str(tmp_path / "s"), 4)
    s.append(spark.createDataFrame([chunk_row(f"f{k}", k) for k in range(40)], S.CHUNKS), 2)
    rows, one = s.rows(), s.file("f3")
    s.replace(spark.createDataFrame([chunk_row("f3", 99)], S.CHUNKS), 2)
    s.vacuum()
    assert rows.count() == 40 and one.first().chunk_id == 3 and s.file("f3").first().chunk_id == 99
    before = {p.name for p in (tmp_path / "s").glob("data-*/bucket=*")}, len(list((tmp_path / "s").glob("data-*/bucket=*")))
    s.vacuum(-10_000)  # nobody reads the old state any more
    named = {d for dirs in s._state()["chunks"].values() for d in dirs}
    assert {f"{p.parent.name}/{p.name}" for p in (tmp_path / "s").glob("data-*/bucket=*")} == named and before[1] > len(named)
    assert s.count() == 40 and len(list((tmp_path / "s").glob("state-*.json"))) == 1


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    """While one writer is between its data and its commit another one commits: to other buckets, and to the same."""
    top = str(tmp_path / "s")
    s = S.Store(spark, top, 4)
    s.write_manifest(S.Manifest("stub", 2))
    s.append(spark.createDataFrame([chunk_row(f"f{k}", k) for k in range(40)], S.CHUNKS), 2)
    write, done = S.Store._write_chunks, []

    def slow(self, rows):
        out = write(self, rows)
        if not done:
            done.append(1)
            S.Store(spark, top, 4).delete(spark.createDataFrame([("f1",), ("f2",), ("f3",), ("f4",), ("f5",)], "file_path string"))
            S.Store(spark, top, 4).append(spark.createDataFrame([chunk_row("new", 500)], S.CHUNKS), 2)
        return out

    monkeypatch.setattr(S.Store, "_write_chunks", slow)
    s.replace(spark.createDataFrame([chunk_row("f9", 909, "new")], S.CHUNKS), 2)
    got = {(r.file_path, r.chunk_id) for r in s.rows().collect()}
    assert got == {(f"f{k}", k) for k in range(40) if k not in (1, 2, 3, 4, 5, 9)} | {("f9", 909), ("new", 500)}
    assert s.manifest().chunk_count == len(got) == s.count()
    assert {n for n, _ in s._listed() if n.startswith("aside-")} == set()


def test_an_index_of_another_model_is_built_anew(spark, tmp_path):
    root = project(tmp_path / "p", FILES)
    engine(spark, root).index()
    new = settings(embedding={"model": "stub-2", "dimensions": 4})
    with pytest.raises(S.ModelMismatch):
        E.Engine(spark, str(root), new, buckets=4)
    e = E.Engine(spark, str(root), new, validated=False, buckets=4)
    assert e.search("hent").degraded_hint == E.MISMATCH_HINT
    with pytest.raises(S.ModelMismatch):
        (root / "src/beta.py").write_text("def beta():\n    pass\n")
        e.reindex_file("src/beta.py")
    assert e.index().chunk_count == 3 and (e.store.manifest().embedding_model, e.store.manifest().dimensions) == ("stub-2", 4)
    assert {len(r.vector) for r in e.store.rows().collect()} == {4} and e.search("hent").degraded_hint is None
    e2 = engine_of = E.Engine(spark, str(root), settings(), validated=False, buckets=4)
    engine_of.clear()
    assert e2.stats() == E.Stats() and e2.index().chunk_count == 3 and E.Engine(spark, str(root), settings(), buckets=4).stats().chunk_count == 3


FIXTURES = {
    "small": ({"src/lib.rs": "fn greet() {}\n", "src/math.rs": "fn add() {}\n", "Cargo.toml": "x\n"}, {}, {"Cargo.toml": False, "src/lib.rs": False, "src/math.rs": False}),
    "several languages": ({"src/greet.rs": "", "src/index.ts": "", "src/utils.py": ""}, {}, {"src/greet.rs": False, "src/index.ts": False, "src/utils.py": False}),
    "overrides": ({"src/keep.rs": "", "src/skip.rs": "", "src/reinclude.rs": ""}, {".indexignore": "skip.rs\nreinclude.rs\n", ".indexinclude": "reinclude.rs\n"}, {"src/keep.rs": False, "src/reinclude.rs": True}),
    "docs that git ignores": ({"src/lib.rs": "", "docs/guide.md": "", "docs/sub/api.md": ""}, {".gitignore": "docs/\n", ".indexinclude": "docs/\n"}, {"src/lib.rs": False, "docs/guide.md": True, "docs/sub/api.md": True}),
    "nested include": ({"src/lib.rs": "", "docs/guide.md": "", "docs/sub/api.md": ""}, {".gitignore": "docs/\n", "docs/.indexinclude": "*.md\n"}, {"src/lib.rs": False, "docs/guide.md": True, "docs/sub/api.md": True}),
    "nested ignore": ({"src/keep.rs": "", "src/gen/gen.rs": ""}, {"src/gen/.indexignore": "*\n"}, {"src/keep.rs": False}),
    "many alike": ({f"src/mod_{k:02d}.rs": "fn f() {}\n" for k in range(10)}, {}, {f"src/mod_{k:02d}.rs": False for k in range(10)}),
    "unknown only": ({"Makefile": "", "README.md": "", "notes.txt": ""}, {}, {"Makefile": False, "README.md": False, "notes.txt": False}),
}


@pytest.mark.parametrize("folders", [1, 3, 256])
def test_a_tree_is_dealt_out_by_subtrees(spark, tmp_path, folders):
    """Each fixture gives the files that its rules keep, wherever the tree is cut; the driver sees directories only."""
    for name, (made, rules, want) in FIXTURES.items():
        root = project(tmp_path / name, made | rules)
        got = files_.tree(spark, str(root), folders=folders).collect()
        assert {r.rel_path: r.force_indexed for r in got} == want and len(got) == len(want), name
        parts = files_.TreeReader({"path": str(root), "folders": str(folders)}).partitions()
        assert all((root / p.folder).is_dir() for p in parts) and (folders > 1 or [(p.folder, p.deep) for p in parts] == [("", True)])


def test_contents_are_read_by_tasks(spark, tmp_path):
    root = project(tmp_path / "p", {"a.py": "x = 1\n", "big.py": "y" * 3000, "b [1]*.py": "z"})
    got = {r.rel_path: bytes(r.content) for r in files_.enumerate_files(spark, str(root), max_kb=2).collect()}
    assert got == {"a.py": b"x = 1\n", "b [1]*.py": b"z"}
    gone = spark.createDataFrame([("a.py", False), ("never.py", True)], "rel_path string, force_indexed boolean")
    assert [r.rel_path for r in files_.read_files(gone, str(root)).collect()] == ["a.py"]


def test_after_an_edit(spark, tmp_path):
    """Only what an edit brought is asked with, and nothing is shown that the session knows."""
    from lodestone.operators import hints

    root = project(tmp_path / "p", FILES | {"src/twin.py": "def alpha_one():\n    return 'hent'\n"})
    e = E.Engine(spark, str(root), settings(hooks={"related_min_similarity": 0.0}), buckets=4)
    e.index()
    assert e.after_edit("src/alpha.py", "s").count() == 0  # nothing changed
    (root / "src/alpha.py").write_text(FILES["src/alpha.py"] + "\n\ndef alpha_one():\n    return 'hent'\n")
    assert e.after_edit("src/alpha.py", None).count() == 0 and e.stats().chunk_count == 5 + 1
    (root / "src/beta.py").write_text("class Beta:\n    def hest(self):\n        return 3\n")
    got = e.after_edit("src/beta.py", "s").collect()
    assert got and {r.edited_path for r in got} == {"src/beta.py"} and "src/beta.py" not in {r.file_path for r in got} and [r.rank for r in got] == list(range(1, len(got) + 1))
    (root / "src/beta.py").write_text("class Beta:\n    def hest(self):\n        return 4\n")
    first = got[0]
    seen = spark.createDataFrame([("s", first.file_path, first.name, 1, 99), ("other", "src/twin.py", "alpha_one", 1, 99)], "session string, file_path string, name string, line_start long, line_end long")
    later = e.after_edit("src/beta.py", "s", seen=seen)
    shown = {(r.file_path, r.name, r.line_start) for r in later.collect()}
    assert shown and (first.file_path, first.name, first.line_start) not in shown
    assert all(r.context.startswith("related code: src/") for r in hints.contexts(later).collect())
