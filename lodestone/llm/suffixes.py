"""Suffix-array dedup with a sparse suffix array.

Suffixes start at words. Retained are those at minimisers: of eleven neighbouring places the one whose next
forty words hash lowest. Two texts that share fifty words share such a place and the forty words after it. The
retained suffixes are dealt out by ranges of their leading forty words (in the order of their hash) and sorted
within each range; a suffix that agrees with a neighbour of another document on all forty is a match, which is
then extended to the left and right: all runs of fifty words around it are brought together in turn, so that two
documents meet whatever an earlier one shares with both, and matches on one diagonal of two documents merge. A
range may end within the suffixes of one prefix, so frequent passages are spread over tasks; what the two
sides of such a border hold is compared afterwards. Frequent passages cost a row an occurrence: each is compared
with the passage's first occurrence, never with all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

MIN_WORDS, WINDOW = 50, 11
#: Words of the prefix by which suffixes are sorted.
PREFIX = MIN_WORDS - WINDOW + 1
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def prefix_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, from running sums of a polynomial."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, C.U64)
    powers = np.full(len(h), BASE, C.U64)
    powers[0] = 1
    powers = np.cumprod(powers)
    total = np.concatenate([[C.U64(0)], np.cumsum(h * powers, dtype=C.U64)])
    back = np.full(n, INVERSE, C.U64)
    back[0] = 1
    return C.mix((total[k:] - total[:n]) * np.cumprod(back))


def minimisers(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the lowest hash in each window; a stretch of equal hashes keeps two places a window at most."""
    n = len(h)
    if n <= window:
        return np.array([int(h.argmin())]) if n else np.empty(0, np.int64)
    at = np.unique(np.lib.stride_tricks.sliding_window_view(h, window).argmin(1) + np.arange(n - window + 1))
    same = np.concatenate([[False], (h[at[1:]] == h[at[:-1]]) & (np.diff(at) < window)])
    if same.any():
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(at))))
        part = (at - at[first]) // window
        new = ~same | (np.diff(part, prepend=-1) != 0)
        at = at[new | np.append(new[1:], True)]
    return at


def suffix_rows(docs: DataFrame, prefix: int = PREFIX, window: int = WINDOW) -> DataFrame:
    """(key, doc_id, pos) of each retained suffix: the hash of its first words, and the word where it starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = C.WordHash()
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for s, e, words in C.word_blocks(batch.column(1), C.SPACED):
                h = hashes.array(words)
                out, start = [], 0
                for doc, end in zip(docs[s:e], np.flatnonzero(h == 0).tolist(), strict=True):
                    if doc is not None and end - start >= prefix:
                        own = prefix_hashes(h[start:end], prefix)
                        at = minimisers(own, window)
                        out.append((own[at].view(np.int64), np.full(len(at), doc, np.int64), at.astype(np.int32)))
                    start = end + 1
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out])) for k in range(3)], ["key", "doc_id", "pos"])

    return docs.mapInArrow(run, "key long, doc_id long, pos int")


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc_id, pos, edge) of the suffixes of one sorted range that agree with one of another document.

    edge: those of the range's first and last prefix which no other document has here.
    """

    def out(rows, edge):
        columns = [pa.array(x) for x in rows] + [pa.array(np.full(len(rows[0]), edge))]
        return pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "pos", "edge"])

    # the last prefix so far: its suffixes while one document has them all, and whether several have it
    held = last = None
    several, first = False, True
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(k).to_numpy() for k in range(3)]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        keys, docs, _ = rows
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        ends = np.append(starts[1:], len(keys))
        match = docs[starts] != docs[ends - 1]
        match[0] |= several and keys[0] == last
        if first and len(starts) > 1:
            first = False
            if not match[0]:
                yield out([x[: ends[0]] for x in rows], True)
        last, several = keys[-1], bool(match[-1])
        held = None if several else [x[starts[-1] :] for x in rows]
        kept = np.repeat(match, ends - starts)
        if kept.any():
            yield out([x[kept] for x in rows], False)
    if held is not None:
        yield out(held, True)


def matches(rows: DataFrame, scratch: C.Scratch) -> DataFrame:
    """(doc_id, pos) of the suffixes that share their prefix with one of another document; ``rows`` is a written table."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "doc_id", "pos"]
    sorted_rows = rows.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order)
    found = scratch.put(sorted_rows.mapInArrow(_neighbours, "key long, doc_id long, pos int, edge boolean"))
    # at most two prefixes a range
    open_keys = found.where("edge").select("key").distinct()
    across = found.join(F.broadcast(open_keys), "key").groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    across = across.where("low < high").select("key")
    kept = found.where("edge").join(F.broadcast(across), "key", "left_semi")
    return found.where("not edge").select("doc_id", "pos").union(kept.select("doc_id", "pos"))


def passage_rows(docs: DataFrame, places: DataFrame, words: int = MIN_WORDS, window: int = WINDOW) -> DataFrame:
    """(key, check, doc_id, pos) of each run of ``words`` words that holds the prefix of a suffix at one of ``places`` (doc_id, pos).

    key and check are independent hashes of the run, of 96 bits together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = C.WordHash()

        def pack(rows):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([r[k] for r in rows])) for k in range(4)], ["key", "check", "doc_id", "pos"])

        for batch in batches:
            rows, held = [], 0
            for doc, text, at in zip(batch.column(0).to_pylist(), C.binary(batch.column(1)), batch.column(2), strict=True):
                h = hashes.array((text.as_py() or b"").translate(C.SPACED).split())
                own = prefix_hashes(h, words)
                starts = (at.values.to_numpy()[:, None] - np.arange(window)).ravel()
                inside = np.zeros(len(own), bool)
                inside[starts[(starts >= 0) & (starts < len(own))]] = True
                starts = np.flatnonzero(inside)
                check = (prefix_hashes(C.mix(h + C.U64(words)), words)[starts] >> C.U64(32)).astype(np.uint32).view(np.int32)
                rows.append((own[starts].view(np.int64), check, np.full(len(starts), doc, np.int64), starts.astype(np.int32)))
                held += len(starts)
                if held > 100_000:
                    yield pack(rows)
                    rows, held = [], 0
            if rows:
                yield pack(rows)

    places = places.groupBy("doc_id").agg(F.collect_list("pos").alias("places"))
    return docs.join(places, "doc_id").select("doc_id", "text", "places").mapInArrow(run, "key long, check int, doc_id long, pos int")


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, window: int = WINDOW) -> DataFrame:
    """Repeated passages: doc_id, start, n_words, source_id, source_start (in white-space words).

    ``docs`` has doc_id and text; other columns are not read. Every passage of ``min_words`` or more that
    stands in more than one document is found, in all of its documents; the document with the smallest doc_id
    is the source, with a row of its own (source_id = doc_id). Where parts of a passage have different first
    documents it has a row for each of them, and together these cover it. Words are compared with A-Z in lower case. Null, empty and
    short texts and rows without a doc_id have no row; rows that share a doc_id are one document, and which of some
    equal runs of one document is its first is the one that starts first. An empty table gives no rows.
    """
    scratch = C.Scratch(docs.sparkSession)
    docs = docs.select(C.whole("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    prefix = min_words - window + 1
    rows = scratch.put(suffix_rows(docs, prefix, window))
    places = scratch.put(matches(rows, scratch), rows.count())
    scratch.free(rows)
    runs = scratch.put(passage_rows(docs, places, min_words, window))
    scratch.free(places)
    n = runs.count()
    shared = C.first_holders(runs, scratch, n)
    scratch.free(runs)
    pairs = shared.select("doc_id", "pos", F.col("low").alias("source_id"), F.col("low_pos").alias("source_pos"))
    pairs = pairs.where("doc_id <> source_id or pos <> source_pos").withColumn("diagonal", F.col("pos") - F.col("source_pos"))
    # matches of two documents on one diagonal without a word between them are one passage
    line = Window.partitionBy("doc_id", "source_id", "diagonal").orderBy("pos")
    new = (F.col("pos") - F.coalesce(F.lag("pos").over(line), F.lit(-(1 << 30))) > min_words).cast("int")
    pairs = pairs.withColumn("new", new).withColumn("part", F.sum("new").over(line))
    out = pairs.groupBy("doc_id", "source_id", "diagonal", "part").agg(F.min("pos").alias("start"), (F.max("pos") - F.min("pos") + min_words).cast("int").alias("n_words"))
    out = scratch.put(out.select("doc_id", "start", "n_words", "source_id", (F.col("start") - F.col("diagonal")).cast("int").alias("source_start")), n)
    scratch.free(shared)
    return out.union(out.select("source_id", "source_start", "n_words", "source_id", "source_start")).distinct()


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of fifty words that documents share, in each of them."""
    return repeats(C.table(spark, sf_dir, "documents"))
