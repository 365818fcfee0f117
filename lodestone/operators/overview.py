"""Directory roll-ups and index status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X


def rollup(chunks: DataFrame, prefix: str | None = None) -> DataFrame:
    """Per directory its files, chunks and languages (most chunks first, then by name)."""
    if prefix:
        chunks = chunks.where(X.path_prefix(F.col("file_path"), prefix))
    by = chunks.withColumn("directory", X.parent_dir(F.col("file_path")))
    # one pass: languages within directories, and distinct files beside them
    langs = by.groupBy("directory", "language").agg(F.count("*").alias("n"))
    langs = langs.groupBy("directory").agg(F.sum("n").alias("chunk_count"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "language"))).alias("l"))
    files = by.groupBy("directory").agg(F.countDistinct("file_path").alias("file_count"))
    out = langs.join(files, "directory")
    named = F.transform("l", lambda x: F.struct(x["language"].alias("language"), (-x["k"]).alias("chunk_count")))
    return out.select("directory", "file_count", "chunk_count", named.alias("languages")).orderBy("directory")


def totals(rolled: DataFrame) -> DataFrame:
    """Grand totals as sums over directories."""
    return rolled.agg(F.sum("file_count").alias("file_count"), F.sum("chunk_count").alias("chunk_count"), F.count("*").alias("directories"))


def freshness(last: Column, now: Column, hours: int = 24) -> Column:
    """P25: whether an RFC-3339 time is missing, unreadable, or older than ``hours``; the future is fresh."""
    at = X.parse_rfc3339(last)
    return at.isNull() | (F.unix_timestamp(now) - F.unix_timestamp(at) > hours * 3600)


def zero_chunks(enumerated: int, chunks: int) -> str | None:
    """A25."""
    return f"{enumerated} files gave no chunks" if enumerated and not chunks else None
