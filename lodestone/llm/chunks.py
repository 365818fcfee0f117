"""Substring dedup by content-defined chunking with a gear rolling hash.

The gear hash of a place sums a random number for each of the last 16 bytes, shifted by their age, so a cut
depends on the bytes around it alone: an insertion moves the cuts around it and no others. Cuts are word starts,
the one of lowest hash of every few neighbours; a longer chunk than 256 bytes is cut further at low hashes. Of a
passage of MIN_WORDS words, two cuts at least and all between them depend on its own bytes only, so every copy
of it holds the same whole chunk. Chunks whose digest is found in more than one document are anchors: between
these cuts a run of MIN_WORDS words that is shared holds no other chunk. The runs that pass are compared as wholes, byte by
byte from their first word to their last (as two independent hashes of 96 bits together), and those found in more
than one document are repeats. Of each the document with the smallest doc_id keeps its copies, all others lose theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C
from .suffixes import BASE, INVERSE

AVERAGE, LEAST, MOST = 32, 8, 256
MIN_WORDS = 50
GEAR = np.random.default_rng(3).integers(0, 1 << 16, 256).astype(np.uint16)
#: A random number for each byte, in hashes of runs of words.
BYTES = np.random.default_rng(4).integers(0, 1 << 64, 256, dtype=np.uint64)
CHECKS = np.random.default_rng(5).integers(0, 1 << 64, 256, dtype=np.uint64)
#: Bytes of white space.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte."""
    h = GEAR[data]
    for k in (1, 2, 4, 8):
        shifted = np.zeros_like(h)
        shifted[k:] = h[:-k] << np.uint16(k)
        h = h + shifted
    return h


def cuts(data: np.ndarray, average: int = AVERAGE, least: int = LEAST, most: int = MOST) -> np.ndarray:
    """Ends of the chunks of a text's bytes; the last is the text's."""
    n = len(data)
    at = np.flatnonzero(gear(data) < 65536 // average) + 1
    at = at[np.diff(at, prepend=-least) >= least]
    at = at[(at >= least) & (at < n)]
    ends = np.append(at, n)
    gaps = np.diff(ends, prepend=0)
    if gaps.max(initial=0) > most:
        starts = ends - gaps
        ends = np.concatenate([np.append(np.arange(s + most, e, most), e) for s, e in zip(starts, ends, strict=True)])
    return ends


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text's bytes."""
    edge = np.diff(np.concatenate([[True], BLANK[data], [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def _window(min_words: int) -> int:
    """Neighbouring word starts of which one is a cut."""
    if min_words < 10:
        raise ValueError("a passage of less than ten words may hold no whole chunk")
    return (min_words - 6) // 4


def word_cuts(data: np.ndarray, starts: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the chunks of a text's bytes, and those of them that words give: the lowest word start of each window, more in long chunks, and the text's end.

    The 16 bytes before a word start are eight words at most. Of the other places of a passage, those a window
    away from either end are chosen by the passage alone; they make up two windows, with a cut in each.
    """
    window = _window(min_words)
    h = gear(data)[np.maximum(starts, 1) - 1]
    if len(h) > window:
        at = np.unique(np.lib.stride_tricks.sliding_window_view(h, window).argmin(1) + np.arange(len(h) - window + 1))
        ends = starts[at]
    else:
        ends = np.empty(0, np.int64)
    ends = whole = np.append(ends[ends > 0], len(data))
    gaps = np.diff(ends, prepend=0)
    if gaps.max(initial=0) > MOST:
        parts = [e - g + cuts(data[e - g : e]) if g > MOST else [e] for e, g in zip(ends.tolist(), gaps.tolist(), strict=True)]
        ends = np.concatenate(parts)
    return ends, whole


def chunk_rows(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(digest, doc_id, start): the chunks of the documents that have ``min_words`` words; the digest covers the size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        C.let_go()
        digest = xxhash.xxh3_64_intdigest

        def pack(rows):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([r[k] for r in rows])) for k in range(3)], ["digest", "doc_id", "start"])

        for batch in batches:
            rows, held = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), C.binary(batch.column(1)), strict=True):
                b = text.as_py()
                if not b or doc is None:
                    continue
                data = np.frombuffer(b, np.uint8)
                own, _ = words(data)
                if len(own) < min_words:
                    continue
                ends, _ = word_cuts(data, own, min_words)
                starts = np.concatenate([[0], ends[:-1]])
                d = np.fromiter([digest(b[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64, len(ends)).view(np.int64)
                rows.append((d, np.full(len(d), doc, np.int64), starts.astype(np.int32)))
                held += len(d)
                if held > 100_000:
                    yield pack(rows)
                    rows, held = [], 0
            if rows:
                yield pack(rows)

    return docs.mapInArrow(run, "digest long, doc_id long, start int")


def run_rows(docs: DataFrame, anchors: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(key, check, doc_id, pos) of runs of ``min_words`` words whose inner chunks are all ``anchors``; pos numbers the first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.let_go()
        names = ["key", "check", "doc_id", "pos"]
        powers = inverse = np.empty(0, np.uint64)
        window = _window(min_words)
        inner = 7 + window

        def table(base, n):
            out = np.full(n, base, np.uint64)
            out[0] = 1
            return np.cumprod(out)

        def sums(data, numbers):
            return np.concatenate([[np.uint64(0)], np.cumsum(numbers[data] * powers[: len(data)], dtype=np.uint64)])

        def pack(rows):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([r[k] for r in rows])) for k in range(len(names))], names)

        for batch in batches:
            rows, held = [], 0
            for doc, text, shared in zip(batch.column(0).to_pylist(), C.binary(batch.column(1)), batch.column(2), strict=True):
                b = text.as_py()
                if not b:
                    continue
                data = np.frombuffer(b, np.uint8)
                starts, ends = words(data)
                if len(starts) < min_words:
                    continue
                e, whole = word_cuts(data, starts, min_words)
                s, whole_s = (np.concatenate([[0], x[:-1]]) for x in (e, whole))
                n = len(starts) - min_words + 1
                other = np.zeros(len(whole), bool)
                other[np.searchsorted(whole_s, s[~np.isin(s, shared.values.to_numpy())], "right") - 1] = True
                # cuts at these words of a run depend on nothing outside it
                low, high = starts[inner : inner + n], starts[min_words - window : min_words - window + n]
                until = np.append(whole[other], len(data) + 1)[np.searchsorted(whole_s[other], low)]
                some = np.searchsorted(whole, high, "right") > np.searchsorted(whole_s, low)
                pos = np.flatnonzero((until > high) & some)
                if not len(pos):
                    continue
                if len(powers) <= len(data):
                    powers, inverse = (table(x, 2 * len(data) + 1) for x in (BASE, INVERSE))
                first, last = starts[pos], ends[pos + min_words - 1]
                size = (last - first).astype(np.uint64) * np.uint64(BASE)
                key, check = (C.mix((t[last] - t[first]) * inverse[first] + size) for t in (sums(data, BYTES), sums(data, CHECKS)))
                check = (check >> np.uint64(32)).astype(np.uint32).view(np.int32)
                rows.append((key.view(np.int64), check, np.full(len(pos), doc, np.int64), pos.astype(np.int32)))
                held += len(pos)
                if held > 100_000:
                    yield pack(rows)
                    rows, held = [], 0
            if rows:
                yield pack(rows)

    anchors = anchors.groupBy("doc_id").agg(F.collect_list("start").alias("starts"))
    return docs.join(anchors, "doc_id").select("doc_id", "text", "starts").mapInArrow(run, "key long, check int, doc_id long, pos int")


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, scratch: C.Scratch | None = None) -> DataFrame:
    """Repeated passages: doc_id, start, n_words, source_id, cut, in white-space words from 0.

    ``docs`` has doc_id and text; other columns are not read. A passage is a stretch of runs of ``min_words``
    words that each stand in another document, byte for byte. source_id is the smallest doc_id that holds one of
    them, and keeps all its copies; cut lists the [start, end) word ranges of the runs that are kept elsewhere,
    less the words of runs that this document keeps, and is empty where it keeps the passage: every run that several
    documents hold still stands in one after the cuts. Texts that are null, empty or without partners, and rows
    without a doc_id, have no row here. Repeats inside one document alone do not count; rows that share a
    doc_id are one document. An empty table gives no rows.
    """
    scratch = scratch or C.Scratch(docs.sparkSession)
    docs = docs.select(C.whole("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = scratch.put(chunk_rows(docs, min_words))
    n = rows.count()
    # written first, so that the join's sides are plain shuffles and Spark can split a frequent chunk's rows
    classes = rows.groupBy("digest").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    classes = scratch.put(classes.where("low < high").select("digest"), n)
    anchors = scratch.put(rows.join(classes, "digest").select("doc_id", "start"), n)
    scratch.free(rows, classes)
    runs = scratch.put(run_rows(docs, anchors, min_words))
    scratch.free(anchors)
    shared = C.first_holders(runs, scratch, runs.count())
    scratch.free(runs)
    shared = shared.select("doc_id", "pos", "low", (F.col("low") != F.col("doc_id")).alias("away"))
    own = Window.partitionBy("doc_id").orderBy("pos")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("doc_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    far = F.lit(-(1 << 30))
    shared = shared.withColumn("new", (F.col("pos") - F.coalesce(F.lag("pos").over(own), far) > min_words).cast("int"))
    # words of a run that is kept here stay, also where a run that goes overlaps it
    kept = F.when(~F.col("away"), F.col("pos"))
    shared = shared.withColumns({"left": F.last(kept, ignorenulls=True).over(before), "right": F.last(kept, ignorenulls=True).over(after)})
    s = F.greatest(F.col("pos"), F.coalesce(F.col("left"), far) + min_words)
    e = F.least(F.col("pos") + min_words, F.coalesce(F.col("right"), -far))
    shared = shared.withColumns({"s": F.when(F.col("away") & (s < e), s), "e": F.when(F.col("away") & (s < e), e)})
    gone = F.last("e", ignorenulls=True).over(before)
    shared = shared.withColumn("apart", (F.col("s") > F.coalesce(gone, far)).cast("int"))
    shared = shared.withColumn("run", F.sum("new").over(own)).withColumn("part", F.sum(F.coalesce("apart", F.lit(0))).over(own))
    parts = shared.groupBy("doc_id", "run", "part").agg(F.min("pos").alias("pos"), F.max("pos").alias("last"), F.min("low").alias("low"), F.min("s").alias("s"), F.max("e").alias("e"))
    return parts.groupBy("doc_id", "run").agg(
        F.min("pos").cast("long").alias("start"),
        (F.max("last") - F.min("pos") + min_words).cast("long").alias("n_words"),
        F.min("low").alias("source_id"),
        F.array_sort(F.collect_list(F.when(F.col("s").isNotNull(), F.array("s", "e")))).alias("cut"),
    ).drop("run")


def without(text: str, ranges: list) -> str:
    """A text without some [start, end) ranges of its words, from the first byte of the one to the last of the other."""
    b, parts, at = text.encode(), [], 0
    starts, ends = words(np.frombuffer(b, np.uint8))
    for s, e in sorted(ranges):
        s, e = int(starts[s]), int(ends[min(e, len(ends)) - 1])
        parts.append(b[at : max(s, at)])
        at = max(e, at)
    return b"".join([*parts, b[at:]]).decode()


def cut_out(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Texts without their word ranges, where there are any."""
    C.let_go()
    for texts, cut in batches:
        out = [without(t, r) if t is not None and r else t for t, r in zip(texts.to_pylist(), cut.to_pylist(), strict=True)]
        yield pa.array(out, pa.string())


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id") -> DataFrame:
    """``docs`` with repeated passages cut out of all texts but the first, the one with the smallest ``key``.

    ``key`` is a column of whole numbers that names documents; a row without it stays as it is, and rows that share
    one are one document, of which each loses what any of them loses. n_chars, where it is there, follows the text.
    A text of which nothing but white space is left goes; one that was null or blank before stays.
    """
    ranges = repeats(docs.select(F.col(f"`{key}`").alias("doc_id"), "text"), min_words).where(F.size("cut") > 0)
    ranges = ranges.groupBy(F.col("doc_id").alias("id")).agg(F.flatten(F.collect_list("cut")).alias("cut"))
    # the row goes as one column, so that no name of it can clash
    rows = docs.select(C.whole(key).alias("key"), F.col("text").cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"))
    out = rows.join(ranges, F.col("key") == F.col("id"), "left")
    # not deterministic to Spark, or it would run once in the filter and once more after it
    new = F.arrow_udf(cut_out, "string").asNondeterministic()("text", "cut")
    out = out.select("row", "cut", new.alias("new")).where(F.col("cut").isNull() | F.col("new").rlike(r"[^\s]"))
    columns = {c: F.col("new") if c == "text" else F.length("new").cast("long") if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns}
    return out.select(*(e.alias(c) for c, e in columns.items()))


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of the documents; ``removed`` says whether an earlier document keeps some of it."""
    out = repeats(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "n_words", "source_id", (F.size("cut") > 0).alias("removed"))
