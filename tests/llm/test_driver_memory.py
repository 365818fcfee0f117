"""The driver gives memory back between the stages of the pipeline."""

import numpy as np
import pyarrow as pa

import corpus_pipeline
from lodestone.llm import packing
from lodestone.llm import toxicity as T


def test_training_gives_memory_back(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(T.C, "released", calls.append)
    monkeypatch.setattr(T, "fit", lambda *a: "machine")
    docs = spark.createDataFrame([(k, f"a b{k}") for k in range(8)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(8)], "doc_id long, toxic int")
    assert T.train(docs, labels) == "machine" and len(calls) == 2
    monkeypatch.setattr(corpus_pipeline.packing, "pack", lambda *a: "pieces")
    assert corpus_pipeline.packed(spark, docs, "unused") == "pieces" and len(calls) == 3


def test_workers_drop_the_tokenizer_for_the_next_operator(spark):
    """A worker lives on after packing; what it keeps for that must not lie below the next run's scoring."""

    def held(batches):
        import gc

        from lodestone.llm.packing import Tokens

        list(batches)
        yield pa.RecordBatch.from_pydict({"id": [sum(isinstance(x, Tokens) for x in gc.get_objects())]})

    def count():
        rows = spark.range(0, 8, 1, 8).mapInArrow(held, "id long")
        return sum(r.id for r in rows.collect())

    docs = spark.createDataFrame([(k, f"some words {k}") for k in range(64)], "doc_id long, text string").repartition(8)
    packing.pieces(docs, packing.vocabulary()).count()
    assert count()
    machine = T.Machine(np.zeros(1 << T.BITS), -1.0, np.zeros(7))
    for _ in range(4):  # tasks go to any of the idle workers
        T.toxicity(docs, machine).select("score").collect()
    assert not count()
