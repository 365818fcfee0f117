"""The library in SQL text."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import sql
from lodestone.functions import text as X
from lodestone.operators import chunking


def test_functions_are_those_of_columns(spark):
    sql.register(spark)
    paths = ["src", "src/a.py", "src.py", "src.tar.gz", "srcs", "", None, "src.d/x"]
    df = spark.createDataFrame([(p, f"A1 b_2\r\n{k}\nc\nd") for k, p in enumerate(paths)], "p string, t string")
    df.createOrReplaceTempView("sql_cases")
    for prefix in ("src/", "src", "", "/"):
        got = spark.sql(f"SELECT p, path_prefix(p, '{prefix}') AS x, snippet(t, 2) AS s, tokenize(t) AS k FROM sql_cases")
        want = df.select("p", X.path_prefix(F.col("p"), prefix).alias("x"), X.snippet(F.col("t"), 2).alias("s"), X.tokenize(F.col("t")).alias("k"))
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
    assert "Python" not in got._jdf.queryExecution().toString()
    row = spark.sql("SELECT cosine(array(1D, 0D), array(1D, 0D)), cosine(array(0D), array(1D)), cosine(array(1D), array(1D, 2D)), cosine(array(), array()), l2_norm(array(3D, 4D))").first()
    assert tuple(row) == (1.0, 0.0, 0.0, 0.0, 5.0)


def test_windows_with_lateral(spark):
    sql.register(spark)
    texts = ["", None, "one line", "\n".join(f"line {k} ünd" for k in range(300)) + "\n", "a\r\nb\r\n" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    df.createOrReplaceTempView("sql_texts")
    got = spark.sql("SELECT k, w.* FROM sql_texts, LATERAL text_windows(t, 8, 1) w ORDER BY k, byte_start, byte_end").collect()
    want = [(k, c.start, c.end) for k, t in enumerate(texts) if t for c in chunking.text_chunks(t.encode(), 8, 1)]
    assert [(r.k, r.byte_start, r.byte_end) for r in got] == want
    for r in got:
        data = texts[r.k].encode()
        assert r.content.encode() == data[r.byte_start : r.byte_end] and r.line_start == data[: r.byte_start].count(b"\n") + 1
        assert r.line_end == data[: r.byte_end].rstrip(b"\n").count(b"\n") + 1
    for bad in ("text_windows(k)", "text_windows(t, k)", "text_windows(t, 2)", "text_windows(t, 8, -1)"):
        with pytest.raises(Exception, match="argument|constant|lines|text"):
            spark.sql(f"SELECT * FROM sql_texts, LATERAL {bad}").collect()
