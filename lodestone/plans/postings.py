"""Stored posting lists: a search reads the buckets of its own terms, and of the best hits only the blocks that can hold them.

Chunks are numbered as they are written, and every 4096 neighbouring numbers are a part. A posting block is what one term has in
one part: numbers, counts and lengths, with the highest count and the least length, from which follows the most that any of its chunks can score.
As all terms share the parts, the sum of a part's bounds limits what a chunk of it can score in all. Blocks lie in hash buckets of
their terms and are sorted by term and part; chunks keep a narrow row each (keys, language, name, length), without their text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.plans import search as S

#: Neighbouring chunks of a part, as a power of two, and buckets of terms.
PART_BITS, BUCKETS = 12, 256
#: Parts that are scored to learn how good a hit has to be.
FIRST_PARTS = 8


class Postings:
    """An index of posting lists under ``root``."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, part_bits: int = PART_BITS):
        self.spark, self.root, self.buckets, self.part_bits = spark, root.rstrip("/"), buckets, part_bits

    # -- building

    def build(self, corpus: DataFrame) -> Postings:
        """Write the index of ``corpus`` (repo, file_path, byte_start, chunk_id, language, name, content).

        A term's list is never in one task: its blocks are grouped by term and part. Tokens are exchanged once, as whole rows by their part,
        in which terms are counted and blocks are made; a term of a chunk is no row of an exchange. Null texts have no terms.
        """
        rows = corpus.select(*S.KEYS, "language", "name", X.tokenize(F.coalesce("content", F.lit(""))).alias("tokens"))
        rows = rows.withColumn("doc", F.monotonically_increasing_id())
        # written with its numbers, so that a task that runs again cannot number anew
        rows.write.mode("overwrite").parquet(f"{self.root}/tokens")
        rows = self.spark.read.schema(rows.schema).parquet(f"{self.root}/tokens")
        rows.select("doc", *S.KEYS, "language", "name", F.size("tokens").alias("dl")).write.mode("overwrite").parquet(f"{self.root}/docs")
        self.docs().agg(F.count("*").alias("n_docs"), F.sum("dl").alias("length")).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/totals")
        blocks = self.lists(rows)
        blocks = blocks.withColumn("bucket", self._bucket(F.col("term")))
        # a large bucket is several files
        blocks.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "part").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/terms")
        fs, p = self._path("tokens")
        fs.delete(p, True)
        return self

    def lists(self, rows: DataFrame) -> DataFrame:
        """The blocks of rows of (doc, tokens)."""
        part = rows.select(F.shiftright("doc", self.part_bits).alias("part"), "doc", "tokens").repartition("part")
        one = part.select("part", "doc", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy("part", "term", "doc", "dl").agg(F.count("*").cast("int").alias("tf"))
        return one.groupBy("part", "term").agg(
            F.count("*").cast("int").alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.array_sort(F.collect_list(F.struct("doc", "tf", "dl"))).alias("list")
        )

    def _path(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    # -- reading

    def docs(self) -> DataFrame:
        """doc, keys, language, name and dl of every chunk."""
        return self.spark.read.parquet(f"{self.root}/docs")

    def blocks(self, tokens: list[str]) -> DataFrame:
        """The blocks of some terms, from the folders of their buckets; terms that no chunk has are nothing."""
        terms = list(dict.fromkeys(tokens))
        schema = "term string, part long, n int, max_tf int, min_dl int, list array<struct<doc:long,tf:int,dl:int>>"
        wanted = {r.b for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(self._bucket(F.col("t")).alias("b")).collect()} if terms else set()
        dirs = [d for b in sorted(wanted) for fs, p in [self._path(f"terms/bucket={b}")] if fs.exists(p) for d in [str(p)]]
        if not dirs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*dirs).where(F.col("term").isin(terms))

    def _totals(self, allowed: DataFrame | None) -> tuple[int, float]:
        """A2: how many chunks there are and their mean length."""
        if allowed is None:
            r = self.spark.read.parquet(f"{self.root}/totals").first()
        else:
            r = allowed.agg(F.count("*").alias("n_docs"), F.sum("dl").alias("length")).first()
        return r.n_docs, (r.length or 0) / r.n_docs if r.n_docs else 0.0

    def _allowed(self, languages: list[str] | None, prefix: str | None) -> DataFrame | None:
        return S.filtered(self.docs(), languages, prefix).select("doc", "dl") if languages or prefix else None

    @staticmethod
    def _part(idf: Column, tf: Column, dl: Column, avgdl: float, s: S.Settings) -> Column:
        length = F.lit(1 - s.b) + F.lit(s.b) * F.greatest(dl.cast("double"), F.lit(1.0)) / F.lit(max(avgdl, 1.0))
        return idf * tf * (s.k1 + 1) / (tf + s.k1 * length)

    def _idf(self, counts: dict[str, int], n: int) -> Column:
        """Of a term, from a table of the query's few terms."""
        values = {t: math.log((n - c + 0.5) / (c + 0.5) + 1.0) for t, c in counts.items()}
        return F.element_at(F.create_map(*(x for t, v in values.items() for x in (F.lit(t), F.lit(v)))), F.col("term"))

    def bm25(self, query: str, languages: list[str] | None = None, prefix: str | None = None, s: S.Settings = S.Settings()) -> DataFrame:
        """A1-A4: (doc, bm25) of the chunks in which a token of the query stands; filters come before the statistics."""
        tokens, allowed = X.tokens_of(query), self._allowed(languages, prefix)
        rows = self.blocks(tokens).select("term", F.explode("list").alias("x")).select("term", "x.doc", "x.tf", "x.dl")
        if allowed is not None:
            rows = rows.join(allowed.select("doc"), "doc", "left_semi")
            counts = {r.term: r.n for r in rows.groupBy("term").agg(F.count("*").alias("n")).collect()}  # the query's terms
        else:
            counts = {r.term: r.n for r in self.blocks(tokens).groupBy("term").agg(F.sum("n").alias("n")).collect()}
        if not counts:
            return self.spark.createDataFrame([], "doc long, bm25 double")
        n, avgdl = self._totals(allowed)
        one = rows.withColumn("p", self._part(self._idf(counts, n), F.col("tf"), F.col("dl"), avgdl, s))
        return one.groupBy("doc").agg(F.round(F.sum("p"), 6).alias("bm25"))

    def top(self, query: str, k: int, s: S.Settings = S.Settings(), seen: dict | None = None) -> DataFrame:
        """The ``k`` chunks with the highest BM25: keys and bm25, ties by their keys; ``seen`` is told of how many parts were read.

        The parts with the highest bounds are scored first. Only parts whose bound is not below the k-th best of them are read after that; lists of
        all others are never touched, as bounds are columns of their own.
        """
        tokens = X.tokens_of(query)
        bounds = self.blocks(tokens).select("term", "part", "n", "max_tf", "min_dl")
        counts = {r.term: r.n for r in bounds.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        schema = ", ".join(f"{c} {dict(self.docs().dtypes)[c]}" for c in S.KEYS) + ", bm25 double"
        if not counts or k < 1:
            return self.spark.createDataFrame([], schema)
        n, avgdl = self._totals(None)
        idf = self._idf(counts, n)
        most = bounds.withColumn("p", self._part(idf, F.col("max_tf"), F.col("min_dl"), avgdl, s)).groupBy("part").agg(F.sum("p").alias("most"), F.max("n").alias("n"))
        first, held = [], 0
        for r in most.orderBy(F.desc("most"), "part").limit(max(FIRST_PARTS, k)).collect():
            if len(first) >= FIRST_PARTS and held >= k:
                break
            first.append(r.part)
            held += r.n

        def scored(lists: DataFrame) -> DataFrame:
            rows = lists.select("term", F.explode("list").alias("x")).select("term", "x.doc", "x.tf", "x.dl")
            rows = rows.withColumn("p", self._part(idf, F.col("tf"), F.col("dl"), avgdl, s)).groupBy("doc").agg(F.round(F.sum("p"), 6).alias("bm25"))
            return rows.where("bm25 > 0")

        best = scored(self.blocks(tokens).where(F.col("part").isin(first))).select("bm25").orderBy(F.desc("bm25")).limit(k).collect()
        least = best[-1].bm25 if len(best) == k else 0.0
        # a bound is not rounded and a score is
        hot = most.where(F.col("most") >= least - 1e-6).select("part")
        if seen is not None:
            seen.update(parts=most.count(), read=hot.count(), first=len(first))
        rows = scored(self.blocks(tokens).join(F.broadcast(hot) if hot.limit(10_001).count() <= 10_000 else hot, "part", "left_semi"))
        # of what ties with the last all go on to have their keys
        rows = rows.where(F.col("bm25") >= least).join(self.docs(), "doc")
        return rows.orderBy(F.desc("bm25"), *S.KEYS).limit(k).select(*S.KEYS, "bm25")

    def search(self, query: str, vector: DataFrame | list[float] | None = None, corpus: DataFrame | None = None, languages: list[str] | None = None, prefix: str | None = None, s: S.Settings = S.Settings()) -> DataFrame:
        """V1-V3: what ``search.search`` gives, with term statistics from the index.

        With a ``vector`` the vectors of ``corpus`` (keys, language, vector) are scanned, and nothing else of it; without one only chunks
        that hold a token, or whose name does, are looked at.
        """
        tokens = X.tokens_of(query)
        docs = S.filtered(self.docs(), languages, prefix).withColumn("ident", X.name_hit(F.col("name"), tokens))
        found = docs.join(self.bm25(query, languages, prefix, s), "doc", "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
        if vector is None or corpus is None:
            rows = found.where("bm25 > 0 or ident").withColumn("dense", F.lit(0.0))
        else:
            near = S.dense(S.filtered(corpus.select(*S.KEYS, "language", "vector"), languages, prefix), vector).select(*S.KEYS, "dense")
            rows = near.join(found.select(*S.KEYS, "bm25", "ident"), S.KEYS)
        return S.ranked(rows.select(*S.KEYS, "dense", "bm25", "ident"), s)
