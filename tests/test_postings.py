"""Stored postings against the search that counts in place."""

import random

import pytest

from lodestone.plans import postings as P
from lodestone.plans import search as S

SCHEMA = "repo string, file_path string, byte_start int, chunk_id long, language string, name string, content string, vector array<float>"


def corpus(spark, n=600, seed=3):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "Epsilon"] + [f"w{k}" for k in range(60)]
    weights = [20, 10, 4, 1, 1] + [6] * 60
    rows = []
    for k in range(n):
        text = None if k % 97 == 0 else "" if k % 89 == 0 else ", ".join(rng.choices(words, weights, k=rng.randrange(1, 60)))
        if k % 150 == 7:
            text = "delta delta delta gamma " + (text or "")
        rows.append(("r", f"d{k % 23}/f{k % 41}", 0, k, "en" if k % 3 else "fr", "delta_of" if k % 77 == 5 else None, text, [float(rng.gauss(0, 1)) for _ in range(4)]))
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    c = corpus(spark)
    return c, P.Postings(spark, str(tmp_path_factory.mktemp("postings")), 16, 3).build(c)


@pytest.mark.parametrize("query", ["delta", "alpha beta", "Delta gamma nowhere", "epsilon", "nowhere", "?!"])
def test_scores_and_hits_are_those_of_a_scan(built, query):
    c, index = built
    tokens = S.X.tokens_of(query)
    want = {r.chunk_id: r.bm25 for r in S.bm25(S.term_counts(c, tokens), tokens).collect() if r.bm25 > 0}
    got = index.bm25(query).join(index.docs(), "doc")
    assert {r.chunk_id: r.bm25 for r in got.collect()} == want
    for k in (1, 5, 40):
        best = [(r.chunk_id, r.bm25) for r in index.top(query, k).collect()]
        order = sorted(((b, c) for c, b in want.items()), key=lambda x: -x[0])[:k]
        assert [b for _, b in best] == [b for b, _ in order] and all(want[c] == b for c, b in best) and len({c for c, _ in best}) == len(best)
    assert [tuple(r) for r in index.search(query).collect()] == [tuple(r) for r in S.search(c.drop("vector"), query).collect()]


def test_filters_come_before_the_statistics(built):
    c, index = built
    for more in ({"languages": ["fr"]}, {"prefix": "d1"}, {"languages": ["en"], "prefix": "d2/f"}):
        got = index.search("delta beta", [1.0, 0.0, 0.5, 0.0], c.drop("content"), **more)
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in S.search(c, "delta beta", [1.0, 0.0, 0.5, 0.0], **more).collect()]


def test_a_query_reads_its_own_terms_and_skips_parts(built):
    _, index = built
    one, two = (set(index.blocks(t).inputFiles()) for t in (["delta"], ["delta", "alpha"]))
    every = set(index.spark.read.parquet(f"{index.root}/terms").inputFiles())
    assert one < two and len(two) <= 4 < len(every)
    seen = {}
    index.top("delta gamma", 3, seen=seen)
    assert seen["parts"] > 40 and seen["read"] < seen["parts"] / 4
    # the lists of a scan by bounds alone are not read
    plan = index.blocks(["delta"]).select("term", "part", "n", "max_tf", "min_dl")._jdf.queryExecution().executedPlan().toString()
    assert "list" not in plan.split("ReadSchema")[1]


def test_an_empty_corpus(spark, tmp_path):
    index = P.Postings(spark, str(tmp_path / "none"), 4).build(corpus(spark, 5).limit(0))
    assert index.search("alpha").count() == 0 and index.top("alpha", 3).count() == 0 and index.bm25("alpha").count() == 0


def test_terms_are_counted_where_their_chunks_are(spark):
    """Whole rows of tokens are exchanged, once; no row of a term is."""
    rows = corpus(spark, 50).select(*S.KEYS, "language", "name", S.X.tokenize("content").alias("tokens")).withColumn("doc", S.F.monotonically_increasing_id())
    plan = P.Postings(spark, "unused", 4).lists(rows)._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("Generate explode", 1)
    assert "Exchange" not in above and "Exchange hashpartitioning(part" in below


def test_a_corpus_in_two_tables_is_not_joined_by_its_texts(spark):
    c = corpus(spark)
    one = [0.3, -0.2, 0.9, 0.1]
    narrow = S.narrowed(c.drop("vector"), c.select("chunk_id", "vector"), "delta gamma", one)
    assert not {"content", "vector"} & set(narrow.columns)
    for args in ({}, {"languages": ["en"]}, {"prefix": "d1/"}):
        assert S.search(narrow, "delta gamma", one, **args).collect() == S.search(c, "delta gamma", one, **args).collect()


def test_stale_takes_hits_to_the_files(spark):
    """The files of an index are not exchanged for a few hits."""
    files = spark.createDataFrame([("r", f"f{k}", b"h", 9) for k in range(50)], "repo string, file_path string, file_hash binary, size long")
    hits = spark.createDataFrame([(1, "r", "f3", b"h"), (2, "r", "f4", b"x"), (3, "r", "gone", b"h")], "rank int, repo string, file_path string, file_hash binary")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = S.stale(hits, files)
        assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
        assert {r.rank: r.stale for r in out.collect()} == {1: False, 2: True, 3: True}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
