"""Locks, readiness, health, windows, stored names and interception."""

import pytest
from pyspark.sql import functions as F

from lodestone import engine as E
from lodestone.functions import text as X
from lodestone.operators import chunking, ranges

from test_engine import FILES, engine, project


def test_windows_and_names(spark):
    files = [("a", 3, 10), ("b", 1, 10), ("c", 9, 1), ("d", 1, 1)]
    assert [[f[0] for f in w] for w in chunking.windows(files, 4, 100)] == [["a", "b"], ["c"], ["d"]]
    assert [[f[0] for f in w] for w in chunking.windows(files, 100, 11)] == [["a", "b"], ["c", "d"]] and list(chunking.windows([])) == []
    df = spark.createDataFrame([("rust", "method"), ("cobol", "poem"), (None, None)], "l string, k string")
    assert [tuple(r) for r in df.select(X.language_from_storage(F.col("l")), X.kind_from_storage(F.col("k"))).collect()] == [("rust", "method"), ("unknown", "other"), ("unknown", "other")]
    hashes = lambda *h: spark.createDataFrame([(x,) for x in h], "content_hash string")
    assert {tuple(r) for r in ranges.replaced(hashes("a", "b", "b"), hashes("b", "c")).collect()} == {("a", "before"), ("c", "after")}


def test_interception_and_following(spark, tmp_path):
    root = project(tmp_path / "p", FILES)
    e = engine(spark, root)
    e.index()
    assert e.intercept("Bash", '{"command": "rg \'where is the hent\'"}') == "where is the hent"
    assert e.intercept("Grep", '{"pattern": "where is the hent"}') == "where is the hent"
    assert e.intercept("Grep", '{"pattern": "where is the hent", "path": "src"}') is None
    assert e.intercept("Bash", '{"command": "ls"}') is None and e.intercept("Grep", '{"pattern": "hent"}') is None and e.intercept("Read", "{}") is None
    assert '"file_path":"src/alpha.py"' in e.search("hent").json()[0] and E.Found(None).json() == []
    (root / "src/alpha.py").write_text("def followed():\n    pass\n")
    spark.createDataFrame([("src/alpha.py",), ("src/alpha.py",), ("skip.py",)], "path string").write.parquet(str(tmp_path / "queue"))
    q = e.follow(spark.readStream.schema("path string").parquet(str(tmp_path / "queue")), str(tmp_path / "state"), availableNow=True)
    q.awaitTermination()
    assert {r.name for r in e.store.file("src/alpha.py").collect()} == {"followed"}
