"""Anti-joins over line and byte ranges, and changed content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlaps(start: Column, end: Column, low: Column, high: Column) -> Column:
    """P10: a null ``high`` reaches to the end of the file."""
    return (start <= F.coalesce(high, F.lit((1 << 31) - 1))) & (end >= low)


def contains(o_start: Column, o_end: Column, start: Column, end: Column) -> Column:
    """P11."""
    return (o_start <= start) & (o_end >= end)


def unseen(ranges: DataFrame, seen: DataFrame, keys: list[str], start: str = "line_start", end: str = "line_end") -> DataFrame:
    """Ranges that no seen range of the same keys contains.

    Instead of comparing every pair of a key's ranges, each key's events are swept in order of start: a range
    is seen if the furthest end among seen ranges that start no later reaches its own end.
    """
    from pyspark.sql.window import Window

    kinds = dict(ranges.dtypes)
    a = ranges.withColumns({"__mine": F.lit(1), "__s": F.col(start).cast("long"), "__e": F.lit(None).cast("long")})
    b = seen.select(*keys, F.lit(0).alias("__mine"), F.col(start).cast("long").alias("__s"), F.col(end).cast("long").alias("__e"))
    rest = [c for c in ranges.columns if c not in keys]
    b = b.select(*keys, *(F.lit(None).cast(kinds[c]).alias(c) for c in rest), "__mine", "__s", "__e")
    sweep = Window.partitionBy(*keys).orderBy("__s", "__mine").rowsBetween(Window.unboundedPreceding, 0)
    out = a.select(*keys, *rest, "__mine", "__s", "__e").union(b).withColumn("__reach", F.max("__e").over(sweep))
    return out.where((F.col("__mine") == 1) & (F.col("__reach").isNull() | (F.col("__reach") < F.col(end)))).select(*ranges.columns)


def innermost(chunks: DataFrame, start: str = "byte_start", end: str = "byte_end") -> DataFrame:
    """Chunks that do not strictly contain another chunk of their file.

    The smallest end among chunks that start no earlier tells: at or below the own end, with a smaller range.
    """
    from pyspark.sql.window import Window

    distinct = chunks.select("file_path", start, end).distinct()
    after = Window.partitionBy("file_path").orderBy(F.desc(start), end)
    before = after.rowsBetween(Window.unboundedPreceding, -1)
    # rows before this one start later, or start with it and end earlier
    outer = distinct.withColumn("__low", F.min(end).over(before)).where(F.col("__low") <= F.col(end)).select("file_path", start, end)
    return chunks.join(outer, ["file_path", start, end], "left_anti")


def changed(chunks: DataFrame, previous: DataFrame) -> DataFrame:
    """Chunks whose content hash their file did not have before; all, if it had none."""
    return chunks.join(previous.select("file_path", "content_hash").distinct(), ["file_path", "content_hash"], "left_anti")


def replaced(before: DataFrame, after: DataFrame) -> DataFrame:
    """(chunk, there): content hashes that an edit took away ("before") or brought ("after"), each once."""
    a, b = (df.select(F.col("content_hash").alias("chunk")).distinct().withColumn(name, F.lit(True)) for df, name in ((before, "b"), (after, "a")))
    both = a.join(b, "chunk", "full_outer").where(F.col("a").isNull() | F.col("b").isNull())
    return both.select("chunk", F.when(F.col("b").isNotNull(), F.lit("before")).otherwise(F.lit("after")).alias("there"))
