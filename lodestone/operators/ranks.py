"""Order statistics of whole columns: exact places by ranges with sums of their counts, and values at a place by counting digits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.scratch import written

#: Bits that one counting pass looks at; its counts are at most 2 ** DIGIT rows for each value that is asked for.
DIGIT = 16


def placed(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """``df`` with a column ``name``: each row's place in ``order``, from 0.

    Rows are dealt out by ranges of the whole order and sorted there. A range numbers its rows itself, and what lies before it is
    the sum of the earlier ranges' counts, a row a range; equal values of the first column are split where the others differ.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = "__at"
    # an id is the range's number and the place in it; written, so that both are read back as they were given
    rows = written(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(own, F.monotonically_increasing_id()), "ranges")
    part = F.shiftright(own, 33)
    counts = {r.p: r.n for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # a row a range
    before, total = {}, 0
    for p in sorted(counts):
        before[p] = total
        total += counts[p]
    if not before:
        return rows.withColumn(name, F.lit(0).cast("long")).drop(own)
    starts = F.lit([before.get(p, 0) for p in range(max(before) + 1)])
    place = F.get(starts, part.cast("int")).cast("long") + F.col(own).bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn(name, place).drop(own)


def _ordered_bits(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the values, as signed 64-bit ones; -0.0 is 0.0 and NaN is above all."""
    if values.dtype.kind in "iu":
        return values.astype(np.int64)
    x = values.astype(np.float64) + 0.0
    x[np.isnan(x)] = np.nan
    bits = x.view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def _value(bits: int, kind: str):
    if kind != "double":
        return bits
    b = np.int64(bits)
    return float(np.where(b < 0, b ^ np.int64(0x7FFFFFFFFFFFFFFF), b).astype(np.int64).view(np.float64))


def nearest_rank(values: DataFrame, column: str, percents: list[int]) -> DataFrame:
    """(p, value): the value at rank ceil(n * p / 100), from 1; nulls do not count, and without values there are no rows.

    Each pass counts the next digit of the values that share the digits found so far; counts are made in each task first, and
    a pass returns at most 2 ** 16 of them for each value asked for, however many rows there are and however they are spread.
    """
    spark = values.sparkSession
    kind = "double" if dict(values.dtypes)[column] in ("double", "float") or dict(values.dtypes)[column].startswith("decimal") else "bigint"
    source = values.select(F.col(column).cast(kind).alias("v")).where("v is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_ordered_bits(b.column(0).to_numpy(zero_copy_only=False)))], ["bits"])

    bits = written(source.mapInArrow(run, "bits long"), "bits")
    schema = f"p int, value {dict(values.dtypes)[column]}"
    wanted: dict[int, list] = {}  # prefix (an arithmetic shift of the bits) -> percents with the rank that is left within it
    n = bits.count()
    if not n:
        return spark.createDataFrame([], schema)
    wanted = {None: [(p, max(1, (n * p + 99) // 100)) for p in percents]}
    for shift in range(64 - DIGIT, -1, -DIGIT):
        digits = F.shiftright("bits", shift)
        rows = bits if None in wanted else bits.where(F.shiftright("bits", shift + DIGIT).isin(list(wanted)))
        counts: dict = {}
        for r in rows.groupBy(digits.alias("d")).agg(F.count("*").alias("n")).collect():
            counts.setdefault(None if None in wanted else r.d >> DIGIT, []).append((r.d, r.n))
        found: dict[int, list] = {}
        for prefix, own in wanted.items():
            for p, rank in own:
                for d, c in sorted(counts[prefix]):
                    if rank <= c:
                        found.setdefault(d, []).append((p, rank))
                        break
                    rank -= c
        wanted = found
    rows = [(p, _value(b, kind)) for b, own in wanted.items() for p, _ in own]
    return spark.createDataFrame(rows, f"p int, value {kind}").select("p", F.col("value").cast(dict(values.dtypes)[column]).alias("value"))
