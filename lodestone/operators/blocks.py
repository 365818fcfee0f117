"""Blocks of vectors that meet in matrix products, and which of them have to.

Vectors are dealt out by the nearest of a few pivots and their angle to it, so that a block is small on the sphere. What is
known of a block is its range of angles to each pivot; by the triangle inequality two vectors are at least as far apart as
their angles to any pivot differ, so pairs of blocks that cannot reach a cosine are never brought together. A
block is one row with its vectors as bytes. Neighbouring blocks are a group, and there are so many groups whatever the number of blocks. Of each pair of
blocks one is at home and the other visits: a task holds a group's homes, a fixed share of all rows, and visitors stream past it one by one. A visitor comes once to a
group, for all homes that it meets there, so a vector is copied at most once for each group, and what is exchanged grows as the rows do, not as the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.scratch import written

#: Rows of a block, and blocks at most: beyond that many rows blocks grow.
BLOCK, MOST_BLOCKS = 1024, 4096
#: Groups of homes: a vector visits at most so many, and a task holds one of so many parts of the rows.
GROUPS = 48
#: Pivots at most, and parts of the half circle that angles are sorted into.
PIVOTS, RINGS = 64, 48
#: What rounding may do to an angle.
SLACK = 1e-6


def unit_rows(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column scaled to length one, and which rows are usable; others are zero."""
    lists = column.to_pylist()
    width = width or max((len(v) for v in lists if v), default=1)
    x = np.zeros((len(lists), width))
    ok = np.zeros(len(lists), bool)
    for r, v in enumerate(lists):
        if v and len(v) == width and None not in v:
            a = np.array(v, np.float64)
            n = np.sqrt((a * a).sum())
            if np.isfinite(n) and n > 0:
                x[r], ok[r] = a / n, True
    return x, ok


@dataclass
class Blocks:
    """A written table (block, n, x, low, high, keys...) of packed blocks, and the bounds of all of them by number."""

    rows: DataFrame
    keys: list[str]
    width: int
    numbers: np.ndarray
    low: np.ndarray
    high: np.ndarray


def pivots(vectors: DataFrame, n: int) -> np.ndarray:
    """Unit vectors of at most ``n`` rows of (vector), those of the lowest hash; which they are changes the speed, no result."""
    if n < 1:
        return np.empty((0, 1))
    rows = vectors.select("vector", F.xxhash64("vector").alias("h")).where("vector is not null").orderBy("h").limit(n).select("vector").collect()
    if not rows:
        return np.empty((0, 1))
    width = max(len(r.vector) for r in rows)
    x, ok = unit_rows(pa.array([r.vector for r in rows]), width)
    return x[ok]


def pack(df: DataFrame, keys: list[str], points: np.ndarray, width: int, size: int | None = None, every: bool = False) -> Blocks:
    """Blocks of the rows of ``df`` (keys and vector) whose vectors are ``width`` finite numbers and not all zero; with ``every`` the others count as zero."""
    size = size or BLOCK
    source = df.select(*keys, F.col("vector").cast("array<double>").alias("vector"))
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    names = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, ok = unit_rows(b.column(len(keys)), width)
            at = np.flatnonzero(ok | every)
            x = x[at]
            angles = np.arccos(np.clip(x @ points.T, -1, 1)) if len(points) else np.zeros((len(x), 1))
            near = angles.argmin(1)
            ring = (angles[np.arange(len(x)), near] * (RINGS / np.pi)).astype(np.int32)
            packed = pa.array([v.tobytes() for v in x], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(at)) for k in range(len(keys))), packed, pa.array(near.astype(np.int32)), pa.array(ring)], [*keys, "__x", "__near", "__ring"])

    rows = written(source.mapInArrow(dealt, f"{names}, __x binary, __near int, __ring int"), "dealt")
    cells = rows.groupBy("__near", "__ring").agg(F.count("*").alias("n")).orderBy("__near", "__ring").collect()  # at most PIVOTS * RINGS
    total = sum(c.n for c in cells)
    size = max(size, -(-total // MOST_BLOCKS))
    # neighbouring rings of a pivot share a block until it is full; a full ring is split by a hash
    first, parts, block, held = [], [], -1, 0
    for k, c in enumerate(cells):
        if c.n > size:
            first.append(block + 1)
            parts.append(-(-c.n // size))
            block, held = block + parts[-1], size
        else:
            if k == 0 or held + c.n > size or (held >= size // 4 and c["__near"] != cells[k - 1]["__near"]):
                block, held = block + 1, 0
            first.append(block)
            parts.append(1)
            held += c.n
    table = pa.table({"__near": pa.array([c["__near"] for c in cells], pa.int32()), "__ring": pa.array([c["__ring"] for c in cells], pa.int32()), "__first": pa.array(first, pa.int32()), "__parts": pa.array(parts, pa.int32())})
    placed = rows.join(F.broadcast(df.sparkSession.createDataFrame(table)), ["__near", "__ring"])
    placed = placed.withColumn("block", (F.col("__first") + F.pmod(F.xxhash64(*keys), F.col("__parts"))).cast("int")).select("block", *keys, "__x")

    def packed(t: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(t.column("__x").to_pylist()), np.float64).reshape(-1, width)
        angles = np.arccos(np.clip(x @ points.T, -1, 1)) if len(points) else np.zeros((len(x), 1))
        lists = [pa.array([t.column(k).to_pylist()], pa.list_(t.schema.field(k).type)) for k in keys]
        return pa.table([t.column("block").slice(0, 1), pa.array([len(x)], pa.int32()), pa.array([x.tobytes()], pa.binary()), pa.array([angles.min(0).tolist()]), pa.array([angles.max(0).tolist()]), *lists], ["block", "n", "x", "low", "high", *keys])

    schema = "block int, n int, x binary, low array<double>, high array<double>, " + ", ".join(f"`{k}` array<{kinds[k]}>" for k in keys)
    out = written(placed.groupBy("block").applyInArrow(packed, schema), "blocks")
    bounds = out.select("block", "low", "high").orderBy("block").collect()  # at most MOST_BLOCKS and a few more
    shape = (len(bounds), max(1, len(points)))
    return Blocks(out, keys, width, np.array([b.block for b in bounds], np.int64), np.array([b.low for b in bounds]).reshape(shape), np.array([b.high for b in bounds]).reshape(shape))


def reach(a: Blocks, b: Blocks, least: float) -> np.ndarray:
    """Which pairs of blocks may hold a pair with a cosine of ``least`` or more."""
    most = np.arccos(np.clip(least, -1, 1)) + SLACK
    out = np.ones((len(a.numbers), len(b.numbers)), bool)
    for p in range(a.low.shape[1]):
        apart = np.maximum(a.low[:, p, None] - b.high[None, :, p], b.low[None, :, p] - a.high[:, p, None])
        out &= apart <= most
    return out


def grouped(numbers: np.ndarray) -> np.ndarray:
    """The group of each block of a sorted list of their numbers: neighbours share one."""
    return np.arange(len(numbers)) * min(GROUPS, len(numbers)) // max(1, len(numbers))


def visited(a: Blocks, homes: np.ndarray, visitors: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """(home, block, at): the group in which a block meets one at home; and (home, block, meets): its visit to that group, for all of them."""
    group = grouped(a.numbers)[np.searchsorted(a.numbers, homes)]
    pairs = a.rows.sparkSession.createDataFrame(pa.table({"home": pa.array(group, pa.int32()), "block": pa.array(visitors, pa.int32()), "at": pa.array(homes, pa.int32())}))
    return pairs, pairs.groupBy("home", "block").agg(F.collect_list("at").alias("meets"))


def meet(a: Blocks, b: Blocks, homes: np.ndarray, visitors: np.ndarray, work: Callable, schema: str) -> DataFrame:
    """``work(home, visitor)`` of each pair of a block of ``a`` with one of ``b``; both have number, x and keys, and it gives a record batch or nothing."""
    spark = a.rows.sparkSession
    pairs, visits = visited(a, homes, visitors)
    own = [(f"h{i}", k, a.rows.schema[k].dataType) for i, k in enumerate(a.keys)], [(f"g{i}", k, b.rows.schema[k].dataType) for i, k in enumerate(b.keys)]
    keys_of = lambda mine, on: [(F.col(f"`{k}`") if mine else F.lit(None).cast(kind)).alias(c) for c, k, kind in own[on]]
    at_home = a.rows.join(F.broadcast(pairs.select("home", F.col("at").alias("block")).distinct()), "block")
    at_home = at_home.select("home", F.lit(False).alias("guest"), "block", "x", F.array().cast("array<int>").alias("meets"), *keys_of(True, 0), *keys_of(False, 1))
    guests = b.rows.join(F.broadcast(visits), "block").select("home", F.lit(True).alias("guest"), "block", "x", "meets", *keys_of(False, 0), *keys_of(True, 1))
    both = at_home.union(guests)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * GROUPS)
    both = both.repartition(parts, "home").sortWithinPartitions("home", "guest")
    width = a.width

    mine = range(5, 5 + len(a.keys)), range(5 + len(a.keys), 5 + len(a.keys) + len(b.keys))

    def unpack(batch: pa.RecordBatch, r: int, guest: bool) -> dict:
        keys = [batch.column(k)[r].values for k in mine[guest]]
        return {"number": batch.column(2)[r].as_py(), "x": np.frombuffer(batch.column(3)[r].as_buffer(), np.float64).reshape(-1, width), "keys": keys}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = {}, None
        for batch in batches:
            for r in range(batch.num_rows):
                if at != (now := batch.column(0)[r].as_py()):
                    held, at = {}, now
                one = unpack(batch, r, guest := batch.column(1)[r].as_py())
                if not guest:
                    # a copy of its own, so that the batch can go
                    held[one["number"]] = one | {"x": one["x"].copy(), "keys": [pa.concat_arrays([k]) for k in one["keys"]]}
                    continue
                for home in batch.column(4)[r].as_py():
                    if (out := work(held[home], one)) is not None and out.num_rows:
                        yield out

    return both.mapInArrow(run, schema)
