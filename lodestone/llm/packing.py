"""Sequence packing by minimum bin slack.

A document's tokens are cut into full windows and a remainder. Only the remainders need packing, and how many
there are of each length (at most 2047 numbers, summed by Spark) is all that planning needs. Each step packs
one window: it takes the longest remaining length, and subset sums of the remaining multiset, kept as bits of
an integer, tell which total comes closest to the capacity; tracing back through the sums gives the count of
each length. The pattern is repeated as often as the counts allow, so the plan has few patterns, and its cost
does not depend on the number of documents. Remainders then find their window by their rank in their length,
which comes from counts of hash blocks, not from one sorted list.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

LENGTH = 2048
END = 1
#: Documents in a rank block.
BLOCK_ROWS = 8192


#: Characters of white space, as the tokenizer's pattern has them.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Tokens:
    """Token ids of texts as little-endian 32-bit bytes, as the tokenizer of a JSON file gives them.

    A text is cut around its white space and after words that ASCII punctuation follows, where the tokenizer's own
    splitting always has a border; each piece goes through the tokenizer once and its ids are kept: those of the last
    ``most`` pieces and as many before them. Texts in which an added token of the tokenizer stands are encoded whole.
    """

    def __init__(self, path: str, most: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most = most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        mark = r"!-/:-@\[-`{-~"
        self.parts = re.compile(f" ?[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[{mark}{SPACE}]|\\Z)|[{mark}]+(?=[{SPACE}]|\\Z)| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, text: str) -> bytes:
        if any(a in text for a in self.added):
            return self.encode([text])[0]
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        parts, known = self.parts(text), self.young
        lacking = [p for p in set(parts) if p not in known]
        if lacking:
            old = self.old
            known.update((p, old[p]) for p in lacking if p in old)
            new = [p for p in lacking if p not in known]
            known.update(zip(new, self.encode(new), strict=True))
        out = b"".join(map(known.__getitem__, parts))
        for p in lacking:
            if len(p) > 24:
                del known[p]
        return out


def tokens_of(path: str) -> Tokens:
    """A worker's tokenizer, which keeps what it knows from one task to the next."""
    return C.kept(Tokens, path)


def pieces(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of each window and remainder of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = tokens_of(path), np.array([END], "<u4").tobytes()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                ids = (tokens(text) if text else b"") + end
                n = len(ids) // 4
                for start in range(0, n, length):
                    part = ids[4 * start : 4 * (start + length)]
                    for column, v in zip(out, (doc, start, len(part) // 4, zlib.crc32(part), n), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(C.whole("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def closest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of the given lengths whose sum is the largest within ``capacity``, longest lengths first.

    Bit s of sums[k] is set if the first k lengths reach s. Counts are split into powers of two, so that each
    length adds few rows. Tracing back prefers not to use a later (shorter) item.
    """
    items = []
    for size in sorted(counts, reverse=True):
        left, step = min(counts[size], capacity // size), 1
        while left > 0:
            items.append((size, min(step, left)))
            left -= step
            step *= 2
    mask = (1 << (capacity + 1)) - 1
    sums = [1]
    for size, n in items:
        sums.append((sums[-1] | sums[-1] << (size * n)) & mask)
        if sums[-1] >> capacity & 1:
            break
    at, used = sums[-1].bit_length() - 1, {}
    for k in range(len(sums) - 1, 0, -1):
        if not sums[k - 1] >> at & 1:
            size, n = items[k - 1]
            used[size] = used.get(size, 0) + n
            at -= size * n
    return used


def plan(counts: dict[int, int], capacity: int = LENGTH) -> list[tuple[int, dict[int, int]]]:
    """(repeats, {length: count}) patterns that use up ``counts``."""
    left = {k: n for k, n in counts.items() if n}
    out = []
    while left:
        top = max(left)
        left[top] -= 1
        used = closest({k: n for k, n in left.items() if n and k <= capacity - top}, capacity - top)
        left[top] += 1
        used[top] = used.get(top, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        out.append((times, used))
        for k, n in used.items():
            left[k] -= times * n
            if not left[k]:
                del left[k]
    return out


def pack(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece of each document.

    ``docs`` has doc_id and text; other columns are not read. A null or empty text is the end id alone.
    Repeated rows are documents of their own. Sequences are numbered from 0 without gaps; a sequence's pieces
    lie side by side from offset 0; what is left of it is padding. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = C.Scratch(spark)
    cut = pieces(docs, path, length)
    cut = scratch.put(cut.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(1024))))
    n = cut.count()
    blocks = max(1, n // BLOCK_ROWS)
    cut = cut.withColumn("block", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "salt"), F.lit(blocks)))
    # the rank of a piece in its length: pieces in earlier blocks, then the place in its own
    cell = cut.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    cell = cell.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("length", "block").orderBy("doc_id", "start", "ids_crc32", "salt")
    ranked = cut.join(cell, ["length", "block"]).withColumn("rank", F.col("first") + F.row_number().over(within) - 1)
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``length`` rows
    full = counts.pop(length, 0)
    # for each length, ranges of ranks: pattern number, first rank, pieces a sequence, place in it, first sequence
    ranges, sequence, seen = [], full, {k: 0 for k in counts}
    if full:
        ranges.append((length, 0, full, 1, 0, 0))
    for times, used in plan(counts, length):
        offset = 0
        for size in sorted(used, reverse=True):
            ranges.append((size, seen[size], seen[size] + times * used[size], used[size], offset, sequence))
            seen[size] += times * used[size]
            offset += size * used[size]
        sequence += times
    names = ["length", "low", "high", "per", "at", "base"]
    table = spark.createDataFrame(pa.table({c: pa.array([r[k] for r in ranges], pa.int64()) for k, c in enumerate(names)}))
    # at most a few thousand ranges, whatever the number of documents; grouped, so that each piece meets one row
    table = table.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("low", "high", "per", "at", "base"))).alias("ranges"))
    out = ranked.join(F.broadcast(table), "length")
    r = F.element_at(F.filter("ranges", lambda x: (x["low"] <= F.col("rank")) & (F.col("rank") < x["high"])), 1)
    out = out.withColumn("r", r).withColumn("k", F.col("rank") - F.col("r.low"))
    per = F.col("r.per")
    return out.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("r.base") + F.floor(F.col("k") / per)).cast("long").alias("sequence_id"),
        (F.col("r.at") + F.col("k") % per * F.col("length")).cast("long").alias("offset"),
    )


def vocabulary() -> str:
    """The tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces; repeated rows are documents of their own."""
    return pack(C.table(spark, sf_dir, "documents"), vocabulary())
