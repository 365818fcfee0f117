"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import chunks, decontaminate, embeddings, extract, licenses, minhash, packing, reshard, suffixes, toxicity

WORDS = "the quick brown fox jumps over a lazy dog near green river banks while small birds sing songs of spring and rain".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


LONG = prose(0, 60_000)
#: doc_id, text
ROWS = [(1, prose(1, 80)), (2, prose(1, 80)), (3, None), (4, ""), (5, "  \n\t "), (6, "word"), (7, LONG), (8, prose(8, 120)), (8, prose(8, 120)), (None, prose(9, 70)), (None, None), (10, "naïve Ünï ©   text"), (11, prose(11, 40) + " " + prose(1, 80) + " " + prose(12, 40))]
CLASH = ("score", "digest", "component_id", "kept", "bands", "size", "shard", "block", "n_words", "w", "found", "label", "salt", "rank", "length", "low", "source_id", "spans", "items", "node", "u", "v", "__id", "held_out")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    df = df.withColumns({"lang": F.lit(None).cast("string"), "source": F.when(F.col("doc_id") > 4, F.lit("s")), "n_chars": F.length("text").cast("long")})
    return df.withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, prose(1, 30)), (1, prose(1, 30)), (2, None), (3, ""), (None, "word"), (4, "word"), (5, LONG[:400])], "item_id long, text string").withColumn("doc_id", F.lit(0))


OPERATORS = {
    "decontaminate": lambda d, b: decontaminate.contamination(d, b),
    "toxicity": lambda d, b: toxicity.toxicity(d, toxicity.train(d, d.sparkSession.createDataFrame([(1, 1), (2, 0), (6, 0), (7, 0), (None, 1), (8, None)], "doc_id long, toxic int"))),
    "reshard": lambda d, b: reshard.reshard(d, F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(8)), 8),
    "packing": lambda d, b: packing.pack(d, packing.vocabulary()),
    "minhash": lambda d, b: minhash.near_duplicates(d),
    "licenses": lambda d, b: licenses.scan(d),
    "extract": lambda d, b: extract.extract(d, column="n_chars"),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_each_row_has_a_result(name, docs, benchmark):
    out = OPERATORS[name](docs, benchmark)
    rows = out.collect()
    if name == "packing":
        assert len({(r.doc_id, r.start, r.ids_crc32) for r in rows}) == len({(r.doc_id, r.start, r.ids_crc32) for r in rows if r.length}) and sum(r.start == 0 for r in rows) == len(ROWS)
    else:
        assert len(rows) == len(ROWS)
    assert OPERATORS[name](docs.limit(0), benchmark).count() == 0


@pytest.mark.parametrize("f", [chunks.repeats, suffixes.repeats, chunks.drop_repeats])
def test_repeats_edges(f, docs):
    rows = f(docs).collect()
    ids = {r.doc_id for r in rows}
    if f is chunks.drop_repeats:
        assert {3, 4, 5, 6, 7, 10, None} <= ids and 2 not in ids and len([r for r in rows if r.doc_id == 8]) == 2
        kept = next(r for r in rows if r.doc_id == 11)
        assert prose(11, 30) in kept.text and prose(12, 40)[-100:] in kept.text and prose(1, 80)[100:300] not in kept.text and kept.n_chars == len(kept.text)
        assert set(f(docs).columns) == set(docs.columns)
    else:
        assert ids == {1, 2, 11}
    assert f(docs.limit(0)).count() == 0


def test_empty_benchmark(docs, benchmark):
    rows = decontaminate.contamination(docs, benchmark.limit(0)).collect()
    assert len(rows) == len(ROWS) and not any(r.spans for r in rows)


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [1.0, None], 1), (9, [], 1), (10, [1.0, 0.0], None), (11, [2.0, 0.0], 1), (12, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (13, [0.0, 1.0], 1), (13, [0.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"rep": F.lit(1), "digest": F.lit("x"), "u": F.lit(2)})
    out = embeddings.near_vectors(df).collect()
    assert len(out) == len(rows)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out}
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[11] == (3, 1, False) and got[None] == (3, 1, False)
    for k in (3, 4, 5, 6, 7, 8, 9, 10, 12):
        assert got[k] == (0, k, True)
    assert got[13] == (1, 13, True)
    assert embeddings.near_vectors(df.limit(0)).count() == 0
    texts = df.select(F.concat(F.lit("v"), "vec_id").alias("vec_id"), F.concat(F.lit("l"), "label").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    assert not any(r.kept for r in embeddings.near_vectors(texts).collect()) and embeddings.near_vectors(texts).count() == len(rows)  # no ids, no groups
    texts = df.select("vec_id", F.concat(F.lit("l"), "label").alias("label"), "embedding")
    assert {r.vec_id: r.n_links for r in embeddings.near_vectors(texts).collect()} == {k: n for k, (n, _, _) in got.items()}


def test_pipeline_keeps_every_unique_text(spark, tmp_path):
    """Repeated, null and clashing doc_ids: no unique text goes, no exact copy stays, passages are cut by row."""
    passage = prose(50, 60)
    own = {k: prose(100 + k, 90) for k in range(8)}
    rows = [(1, own[0]), (2, own[0]), (2, own[1]), (8, own[2]), (8, own[2]), (None, own[2]), (None, own[3]), (None, own[3]), (3, None), (4, ""), (4, ""), (None, None)]
    rows += [(5, own[4] + " " + passage), (5, own[5]), (5, own[6] + " " + passage), (None, passage + " " + own[7])]
    d = str(tmp_path)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    df.repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(own[7].split()[20:40]))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        out.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        kept[name] = docs.collect()
    texts = [r.text for r in kept["near_duplicates"] if r.text]
    assert sorted(texts) == sorted({t for _, t in rows if t}) and len(kept["near_duplicates"]) == len(texts) + 4
    assert {r.doc_id for r in kept["near_duplicates"] if r.text == own[0]} == {1}
    texts = [r.text for r in kept["substrings"] if r.text]
    assert sum(passage in t for t in texts) == 1 and all(sum(own[k] in t for t in texts) == 1 for k in own)
    assert all(r.n_chars == len(r.text) for r in kept["substrings"] if r.text)
    assert not any(own[7] in (r.text or "") for r in kept["decontamination"]) and len(kept["decontamination"]) == len(kept["substrings"]) - 1
    assert sum(r.start == 0 for r in kept["packing"]) == len(kept["decontamination"])


def test_stages_on_edges(spark, docs, benchmark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (6, 0, 1), (None, None, 1), (7, 1, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.where("item_id = 5").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = docs.select("doc_id", "text", "lang", "source", "n_chars", *[c for c in CLASH if c not in ("doc_id", "text")])
    for frame in (df, df.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, str(tmp_path))
            rows = out.collect()
            if name != "packing":
                assert out.columns == frame.columns
            if frame is not df:
                assert rows == []
            ids = {r.doc_id for r in rows}
            if frame is df and name == "near_duplicates":
                assert 1 in ids and 2 not in ids and 11 in ids and 7 in ids
            if frame is df and name == "decontamination":
                assert 7 not in ids and {1, 2, 8, 11} <= ids
