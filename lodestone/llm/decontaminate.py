"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

An item's windows are its runs of ten words (a shorter item is one window). A window is contained in a
document only if all its shingles are, so the necessary prefix of its shingles, ordered by rarity over all
documents, is the rarest one. Pass one counts the benchmark's shingles in all documents, pre-aggregated in
each task. Pass two joins documents with prefix shingles by a hash table, applies the length and positional
bounds (the window must fit into the document around the shingle) and verifies the window's words exactly.

The benchmark is read in blocks of at most BLOCK_WORDS words, each broadcast; a longer item's windows go to several
blocks. Texts are never shuffled. With one block hits are a column of the document's row; with more, each block's hits
are written under a number that every row gets first, and meet by it.
"""

from __future__ import annotations

import functools
import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WINDOW = 10
SHINGLE = 3
#: Words of the benchmark that are broadcast at once; with it the size of a broadcast is bounded.
BLOCK_WORDS = 200_000
HITS = "n_words long, spans array<array<long>>, items array<string>"


class Block:
    """Windows of some items, as arrays of word numbers, and their shingles."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW, shingle: int = SHINGLE):
        self.vocab: dict[bytes, int] = {C.MARK: -2}
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, words in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            n = min(window, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                owners[tuple(ids[i : i + n])].add(item)
        self.windows = [np.array(w, np.int64) for w in owners]
        self.owners = [frozenset(x) for x in owners.values()]
        self.base = len(self.vocab) + 1
        self.widths = sorted({min(shingle, len(w)) for w in self.windows})
        self.shingle = shingle
        if self.base**shingle >= 1 << 62:
            raise ValueError("too many words in one block of the benchmark")
        self.codes = {k: np.unique(np.concatenate([self.code(w, k) for w in self.windows if min(shingle, len(w)) == k])) for k in self.widths}

    def code(self, ids: np.ndarray, k: int) -> np.ndarray:
        """A number for each run of k words; -1 where a word is not the benchmark's."""
        n = max(len(ids) - k + 1, 0)
        out, bad = np.zeros(n, np.int64), np.zeros(n, bool)
        for i in range(k):
            part = ids[i : n + i]
            out = out * self.base + part
            bad |= part < 0
        out[bad] = -1
        return out

    def order(self, counts: dict[tuple[int, int], int]) -> None:
        """Keep of each window the rarest shingle (ties: the first); the index of pass two."""
        self.prefix: dict[int, dict[int, list[tuple[int, int]]]] = {k: defaultdict(list) for k in self.widths}
        for w, ids in enumerate(self.windows):
            k = min(self.shingle, len(ids))
            codes = self.code(ids, k).tolist()
            at = min(range(len(codes)), key=lambda i: (counts.get((k, codes[i]), 0), i))
            self.prefix[k][codes[at]].append((w, at))
        self.keys = {k: np.array(sorted(p), np.int64) for k, p in self.prefix.items()}

    def numbers(self, words: list[bytes]) -> np.ndarray:
        get = self.vocab.get
        return np.fromiter([get(w, -1) for w in words], np.int64, len(words))


def _within(codes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of ``codes`` that hold one of the sorted ``keys``."""
    at = np.flatnonzero(codes >= 0)
    near = np.minimum(np.searchsorted(keys, codes[at]), len(keys) - 1)
    return at[keys[near] == codes[at]]


def _counts(docs: DataFrame, block) -> dict[tuple[int, int], int]:
    """How often each shingle of the block stands in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.let_go()
        b = block.value
        total = {k: np.zeros(len(b.codes[k]), np.int64) for k in b.widths}
        for batch in batches:
            for _, _, words in C.word_blocks(batch.column(0), C.ALNUM):
                ids = b.numbers(words)
                for k in b.widths:
                    codes = b.code(ids, k)
                    found = np.searchsorted(b.codes[k], codes[_within(codes, b.codes[k])])
                    total[k] += np.bincount(found, minlength=len(total[k]))
        for k, n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k)), pa.array(b.codes[k][some]), pa.array(n[some])], ["k", "code", "n"])

    parts = docs.select("text").mapInArrow(run, "k long, code long, n long")
    return {(r.k, r.code): r.n for r in parts.groupBy("k", "code").agg(F.sum("n").alias("n")).toLocalIterator()}


def find(ids: np.ndarray, b: Block) -> list[tuple[int, int, int]]:
    """(start, end, window) of each window's occurrences among word numbers; MARK ends a text."""
    out = []
    for k in b.widths:
        codes = b.code(ids, k)
        places = _within(codes, b.keys[k])
        for pos, code in zip(places.tolist(), codes[places].tolist(), strict=True):
            for w, at in b.prefix[k][code]:
                ids_w, start = b.windows[w], pos - at
                # bounds: the window fits; a MARK inside differs from every word of it
                if start >= 0 and start + len(ids_w) <= len(ids) and np.array_equal(ids[start : start + len(ids_w)], ids_w):
                    out.append((start, start + len(ids_w), w))
    return out


def _hits(block):
    """A column function from text to its words and its hits: [start, end) spans and items."""

    @F.arrow_udf(HITS)
    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        C.let_go()
        b = block.value
        for column in batches:
            n_words, spans, items = [], [], []
            for s, e, words in C.word_blocks(column, C.ALNUM):
                ids = b.numbers(words)
                ends = np.flatnonzero(ids == -2)
                starts = np.concatenate([[0], ends[:-1] + 1])
                own_spans, own_items = [[] for _ in range(e - s)], [set() for _ in range(e - s)]
                for start, end, w in find(ids, b):
                    d = int(np.searchsorted(ends, start))
                    own_spans[d].append((start - int(starts[d]), end - int(starts[d])))
                    own_items[d] |= b.owners[w]
                n_words += (ends - starts).tolist()
                spans += [merged(x) for x in own_spans]
                items += [sorted(x) for x in own_items]
            columns = [pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string()))]
            yield pa.StructArray.from_arrays(columns, ["n_words", "spans", "items"])

    # not deterministic to Spark, or it would run once in a filter and once more after it
    return hits.asNondeterministic()


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """The union of [start, end) spans, in order."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _blocks(benchmark: DataFrame, most: int, window: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items' words, at most about ``most`` at a time; the driver holds one block.

    A longer item goes in parts that overlap by all but one word of a window, so that each window is in one part.
    """
    items, n = [], 0
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where("item_id is not null")
    for item, text in rows.distinct().toLocalIterator():
        words = (text or "").encode().translate(C.ALNUM).split()
        for start in range(0, max(len(words) - window + 1, 1) if words else 0, most):
            part = words[start : start + most + window - 1]
            if n and n + len(part) > most:
                yield items
                items, n = [], 0
            items.append((item, part))
            n += len(part)
    if items:
        yield items


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with n_words, spans (hit word ranges, merged) and items (item ids in string order) for each row.

    ``docs`` has a column text, ``benchmark`` item_id and text; no other column is read. Columns of ``docs`` of the
    three names are replaced. Null and empty texts have no words and no hits; null item ids and items without words
    are left out; rows that repeat an item id count as one item. Each row of ``docs`` has its own result, whatever
    its doc_id is; an empty table has none.
    """
    spark = docs.sparkSession
    C.text_batches(spark)
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ("n_words", "spans", "items")))
    texts, text = docs.select(F.col("text").cast("string").alias("text")), F.col("text").cast("string")

    def indexed(items):
        block = Block(items, window, shingle)
        shared = spark.sparkContext.broadcast(block)
        counts = _counts(texts, shared)
        shared.destroy()
        block.order(counts)
        return _hits(spark.sparkContext.broadcast(block))(text)

    row, hits = (C.unused(x, docs.columns) for x in ("__row", "__hits"))
    blocks = _blocks(benchmark, block_words, window)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return docs.withColumn(hits, indexed(first)).select(*(F.col(f"`{c}`") for c in docs.columns), f"{hits}.*")
    scratch = C.Scratch(spark)
    rows = C.numbered(docs, scratch, row)
    found = scratch.put(rows.select(row, indexed(first).alias("h")).select(row, "h.*"))
    parts = [found.select(row, "spans", "items")]
    for items in itertools.chain([second], blocks):
        parts.append(scratch.put(rows.select(row, indexed(items).alias("h")).where(F.size("h.spans") > 0).select(row, "h.spans", "h.items")))
    every = functools.reduce(DataFrame.union, parts).where(F.size("spans") > 0)
    every = every.groupBy(row).agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    none = (F.array().cast("array<array<long>>"), F.array().cast("array<string>"))
    out = rows.join(found.select(row, "n_words"), row).join(every, row, "left")
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), "n_words", F.coalesce(united("spans"), none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items"))


def united(spans: str) -> F.Column:
    """Spans that may overlap or touch, as their union in order."""
    none = F.array().cast("array<array<long>>")

    def add(done, x):
        last = F.try_element_at(done, F.lit(-1))
        grown = F.array(last[0], F.greatest(last[1], x[1]))
        apart = F.size(done) == 0
        return F.when(apart | (last[1] < x[0]), F.concat(done, F.array(x))).otherwise(F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown)))

    return F.aggregate(F.array_sort(spans), none, add)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of each document's hits; each row of ``documents`` has one, repeated rows repeat it."""
    docs = C.table(spark, sf_dir, "documents").select(C.whole("doc_id").alias("doc_id"), "text")
    hits = contamination(docs, C.table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id",
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x[1] - x[0]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
lens AS (SELECT DISTINCT least(10, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
m AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS sha FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM m) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
