"""The queue as a stream, and a drain that is killed between its write and its commit."""

import pytest

from lodestone.sources import queue_log as L
from lodestone.streaming import queue

from test_engine import FILES, engine, project


def test_ranges_and_unended_lines(spark, tmp_path):
    """Every line once, whatever the ranges; a line that has not ended waits."""
    folder = str(tmp_path / "logs")
    lines = [f"{k}\tp{k % 7}\t{'s' * (k % 30)}" for k in range(500)]
    L.append(folder, lines[:200], "a.log")
    L.append(folder, lines[200:], "b.log")
    with open(f"{folder}/b.log", "ab") as f:
        f.write("501\tünend".encode())
    for size in (1, 7, 64, 4096, 1 << 20):
        r = L.Reader(f"file:{folder}", size)
        end = r.latestOffset()
        got = [x for p in r.partitions({}, end) for b in r.read(p) for x in b.column(0).to_pylist()]
        assert got == lines
        half = {"a.log": len("".join(f"{x}\n" for x in lines[:50]).encode())}
        assert [x for p in r.partitions(half, end) for b in r.read(p) for x in b.column(0).to_pylist()] == lines[50:]
    with open(f"{folder}/b.log", "ab") as f:
        f.write(b"ed\n")
    assert [x for p in r.partitions(end, r.latestOffset()) for b in r.read(p) for x in b.column(0).to_pylist()] == ["501\tünended"]
    with pytest.raises(ValueError):
        L.append(folder, ["a\nb"])
    assert L.Reader(str(tmp_path / "none"), 10).latestOffset() == {}


def test_a_stream_goes_on_at_its_byte(spark, tmp_path):
    folder, at = str(tmp_path / "logs"), str(tmp_path)

    def run():
        rows = queue.parse(L.stream(spark, folder, 16))
        q = rows.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.ts, r.path, r.session) for r in spark.read.schema(rows.schema).parquet(f"{at}/out").collect())

    L.append(folder, ["1\ta\ts", "broken", "2\tb"])
    assert run() == [(1, "a", "s"), (2, "b", None)]
    L.append(folder, ["3\tc\tt"])
    L.append(folder, ["4\td"], "other.log")
    assert run() == [(1, "a", "s"), (2, "b", None), (3, "c", "t"), (4, "d", None)]
    assert len(run()) == 4


def test_a_drain_that_is_killed_between_write_and_commit(spark, tmp_path, monkeypatch):
    root = project(tmp_path / "p", FILES)
    e = engine(spark, root)
    e.index()
    folder, checkpoint = str(tmp_path / "logs"), str(tmp_path / "state")
    (root / "src/beta.py").write_text("def beta():\n    pass\n\n\ndef more():\n    pass\n")
    L.append(folder, ["1\tsrc/beta.py\ts", "2\tsrc/beta.py\tt", "3\tsrc/none.py"])
    follow, calls = e._follow, []

    def killed(paths, batch):
        calls.append((sorted(paths), batch))
        out = follow(paths, batch)
        if len(calls) == 1:
            raise RuntimeError("killed")
        return out

    monkeypatch.setattr(e, "_follow", killed)
    with pytest.raises(Exception, match="killed"):
        e.drain(folder, checkpoint, availableNow=True).awaitTermination()
    after = e.store._state()
    assert after["manifest"]["chunk_count"] == 4 and after["manifest"]["batches"] == {checkpoint: 0}
    # the file goes back to what it was before the batch runs again: its write is known, and nothing changes
    (root / "src/beta.py").write_text(FILES["src/beta.py"])
    e.drain(folder, checkpoint, availableNow=True).awaitTermination()
    assert calls == [(["src/beta.py", "src/none.py"], (checkpoint, 0))] * 2 and e.store._state() == after
    # a later batch goes in
    L.append(folder, ["9\tsrc/beta.py"])
    e.drain(folder, checkpoint, availableNow=True).awaitTermination()
    assert e.stats().chunk_count == 4 - 2 + 2 and e.store.manifest().batches == {checkpoint: 1}


def test_a_drain_waits_and_leaves_what_cannot_be_indexed(spark, tmp_path, monkeypatch):
    from lodestone import engine as E
    from lodestone.operators import store as S

    e = engine(spark, project(tmp_path / "p", FILES))
    slept, calls = [], []
    monkeypatch.setattr(E.time, "sleep", slept.append)

    def busy(paths, now=None, batch=None):
        calls.append((tuple(paths), batch))
        if len(calls) < 4:
            raise S.Conflict("others first")

    monkeypatch.setattr(e, "reindex", busy)
    assert e._follow(["a", "b"], ("c", 3)) == [] and slept == [0.25, 0.5, 1.0] and calls == [(("a", "b"), ("c", 3))] * 4

    def odd(paths, now=None, batch=None):
        calls.append(tuple(paths))
        if "bad" in paths:
            raise ValueError("no text")

    calls.clear()
    monkeypatch.setattr(e, "reindex", odd)
    assert e._follow(["a", "bad", "b"], ("c", 4)) == ["bad"] and calls == [("a", "bad", "b"), ("a",), ("bad",), ("b",)]

    def always(paths, now=None, batch=None):
        raise S.Conflict("others first")

    monkeypatch.setattr(e, "reindex", always)
    with pytest.raises(S.Conflict):
        e._follow(["a"], ("c", 5))
