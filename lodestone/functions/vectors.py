"""Vector columns in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    """F30."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, na: Column | None = None, nb: Column | None = None) -> Column:
    """0 where lengths differ, a vector is empty, or a norm is 0."""
    na, nb = norm(a) if na is None else na, norm(b) if nb is None else nb
    ok = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (na > 0) & (nb > 0)
    return F.when(ok, dot(a, b) / (na * nb)).otherwise(F.lit(0.0))


def valid(v: Column, width: int) -> Column:
    """Not null, of the right width, all components finite."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) == width) & finite


def normalise(column: Column, top: Column) -> Column:
    """by the maximum only, clamped; 0 for all if that is not positive."""
    return F.when(top > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), column / top))).otherwise(F.lit(0.0))


def global_rank(df: DataFrame, score: str, keys: list[str], name: str) -> DataFrame:
    """``df`` with the place among rows of a positive score, highest first, ties by ``keys``; else null.

    Places come from ranges of the whole order (``ranks.placed``), so that no task sorts the corpus, nor all rows of one score.
    """
    from lodestone.operators.ranks import placed

    some = F.coalesce(F.col(score) > 0, F.lit(False))
    ranked = placed(df.where(some), [F.desc(score), *keys], name).withColumn(name, F.col(name) + 1)
    return ranked.unionByName(df.where(~some).withColumn(name, F.lit(None).cast("long")))
