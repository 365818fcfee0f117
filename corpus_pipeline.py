"""A corpus from raw documents to packed sequences: five stages, each a training-data operator.

Each stage is a function of (spark, docs, sf_dir) and works on all that its predecessor kept; all but the
last return the columns of ``docs``. ``run`` writes every stage's result to the shared scratch folder and
reads it again, so that a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import chunks, decontaminate, minhash, packing
from lodestone.llm import common as C
from lodestone.llm import toxicity as T


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.3; the labels that are held out are not learned from.

    Each row is judged by its own text, so repeated rows stay or go together, and ties do not arise. A null, empty or blank text says nothing
    toxic and stays, whatever the labels' share. An empty table gives none; columns of other names stay as they are.
    """
    machine = T.train(docs, C.table(spark, sf_dir, "labels"))
    # the row goes as one column, so that a score of its own stays
    rows = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    blank = ~F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return T.toxicity(rows, machine).where((F.col("score") < 0.3) | blank).select(*(F.col(f"row.`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the smallest doc_id that no other row has, if there is one.

    Rows that say the same and share a doc_id, or have none, are copies too; one of them stays. Rows without words stay.
    """
    C.released(spark)
    scratch, key = C.Scratch(spark), C.unused("__key", docs.columns)
    rows = C.keyed(docs, scratch, key)
    found = scratch.put(minhash.near_duplicates(rows.select(F.col(key).alias("doc_id"), "text")))
    n = found.count()
    gone = scratch.put(found.where("not kept").select(F.col("doc_id").alias(key)).distinct(), n)
    twice = scratch.put(found.where("kept and n_shingles > 0").groupBy(F.col("doc_id").alias(key)).count().where("count > 1").select(key), n)
    rows = rows.join(C.small(gone), key, "left_anti")
    if not twice.isEmpty():
        once = rows.join(C.small(twice), key, "left_semi").dropDuplicates([key])
        rows = rows.join(C.small(twice), key, "left_anti").unionByName(once)
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one holds; those with nothing else go."""
    C.released(spark)
    key = C.unused("__key", docs.columns)
    out = chunks.drop_repeats(C.keyed(docs, C.Scratch(spark), key), key=key)
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item stands.

    Each row by itself, also where doc_ids repeat or are null; null and empty texts have no words and stay, as all do where the benchmark is empty.
    """
    # the row goes as one column, so that no name of it can clash
    rows = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    out = decontaminate.contamination(rows, C.table(spark, sf_dir, "benchmark"))
    return out.where("size(spans) = 0").select(*(F.col(f"row.`{c}`") for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, of every row: a null or empty text is its end id alone, repeated rows are documents of their own.

    Ties of length go by doc_id, start and the ids' checksum. An empty table gives no pieces; columns other than doc_id and text are not read.
    """
    C.released(spark)
    return packing.pack(docs, packing.vocabulary())


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: Hashing, tokenizing and a trained model have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    scratch = C.Scratch(spark)
    docs = C.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.put(docs)
    return docs
