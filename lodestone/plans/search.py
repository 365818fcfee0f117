"""Hybrid search as one DataFrame plan: BM25, cosine, reciprocal-rank fusion, gates, one hit a file.

Term statistics of the query's few tokens are counted per row by array functions and summed in one global
aggregate, so that scoring the corpus needs no exchange of rows; only ranking does.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as X
from lodestone.functions import vectors as V
from lodestone.scratch import written


@dataclass(frozen=True)
class Settings:
    """The defaults of scoring."""

    top_k: int = 10
    dense_weight: float = 0.55
    bm25_weight: float = 0.30
    rrf_weight: float = 0.15
    boost: float = 1.4
    boost_floor: float = 0.3
    similarity_threshold: float = 0.30
    min_score: float = 0.05
    rrf_k: int = 60
    k1: float = 1.2
    b: float = 0.75

    def with_top_k(self, k: int) -> Settings:
        """0 means the default."""
        return replace(self, top_k=k or self.top_k)


KEYS = ["repo", "file_path", "byte_start", "chunk_id"]


def filtered(corpus: DataFrame, languages: list[str] | None = None, prefix: str | None = None) -> DataFrame:
    """Before the statistics, so that filters change scores."""
    if languages:
        corpus = corpus.where(F.col("language").isin(*languages))
    return corpus.where(X.path_prefix(F.col("file_path"), prefix)) if prefix else corpus


def term_counts(corpus: DataFrame, tokens: list[str]) -> DataFrame:
    """A1: ``corpus`` with dl and tf, an array with each distinct query token's count.

    Runs of letters and digits are counted in place, whole tokens only; no text becomes an array of its tokens.
    Rows that have both already (``narrowed``) stay as they are.
    """
    if {"dl", "tf"} <= set(corpus.columns):
        return corpus
    content = F.coalesce(F.col("content"), F.lit(""))
    # each token is one letter in ``marked``, and no other letter is left
    marked = F.regexp_replace(content, "[A-Za-z0-9]+", "a")
    dl = F.length(marked) - F.length(F.replace(marked, F.lit("a"), F.lit("")))

    def count(token: str) -> Column:
        # a query token is letters and digits of ASCII, and so a pattern of its own
        core = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in token)
        whole = F.regexp_count(content, F.lit(f"(?<![A-Za-z0-9]){core}(?![A-Za-z0-9])"))
        return F.when(F.rlike(content, F.lit(core)), whole).otherwise(F.lit(0)).cast("int")

    distinct = list(dict.fromkeys(tokens))
    tf = F.array(*map(count, distinct)) if distinct else F.array().cast("array<int>")
    return corpus.withColumns({"dl": dl.cast("int"), "tf": tf})


def statistics(counted: DataFrame, n_tokens: int) -> DataFrame:
    """A2, A3: one row of N, average length and document frequencies."""
    df = F.array(*(F.sum((F.col("tf")[k] > 0).cast("long")) for k in range(n_tokens))) if n_tokens else F.array().cast("array<long>")
    return counted.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"), df.alias("df"))


def bm25(counted: DataFrame, tokens: list[str], s: Settings = Settings()) -> DataFrame:
    """A4: ``counted`` with a column bm25, 0 where no token occurs."""
    n = len(dict.fromkeys(tokens))
    stats = statistics(counted, n)
    out = counted.crossJoin(F.broadcast(stats))  # one row
    length = F.lit(1 - s.b) + F.lit(s.b) * F.greatest(F.col("dl").cast("double"), F.lit(1.0)) / F.greatest(F.col("avgdl"), F.lit(1.0))

    def part(k: int) -> Column:
        tf, df = F.col("tf")[k].cast("double"), F.col("df")[k].cast("double")
        idf = F.log((F.col("n_docs") - df + 0.5) / (df + 0.5) + 1.0)
        return F.when(tf > 0, idf * tf * (s.k1 + 1) / (tf + s.k1 * length)).otherwise(F.lit(0.0))

    total = reduce(lambda a, b: a + b, (part(k) for k in range(n)), F.lit(0.0))
    return out.withColumn("bm25", F.round(total, 6)).drop("n_docs", "avgdl", "df", "tf", "dl")


def dense(corpus: DataFrame, query: DataFrame | list[float] | None) -> DataFrame:
    """``corpus`` with a column dense, the cosine to the query vector, at least 0.

    ``query`` is a list, a frame of one row and one array column, or nothing (V3: dense is 0). Rows that have it already (``narrowed``) stay as they are.
    """
    if "dense" in corpus.columns:
        return corpus
    if query is None or (isinstance(query, list) and not query):
        return corpus.withColumn("dense", F.lit(0.0))
    if isinstance(query, list):
        q = F.array(*(F.lit(float(x)) for x in query))
        return corpus.withColumn("dense", F.round(F.greatest(F.lit(0.0), V.cosine(V.doubles(F.col("vector")), q)), 6))
    one = query.limit(1).select(V.doubles(F.col(query.columns[0])).alias("__q"))
    out = corpus.crossJoin(F.broadcast(one))
    return out.withColumn("dense", F.round(F.greatest(F.lit(0.0), V.cosine(V.doubles(F.col("vector")), F.col("__q"))), 6)).drop("__q")


def narrowed(texts: DataFrame, vectors: DataFrame, query: str, vector: DataFrame | list[float] | None) -> DataFrame:
    """A corpus whose texts and vectors are two tables, as (keys, language, name, dl, tf, dense) for one query, written once.

    ``texts`` are rows as in ``search`` without vectors, ``vectors`` are (chunk_id, vector). Tokens are counted and cosines taken where the rows are read,
    so that the join by chunk_id exchanges a few numbers and names, and neither texts nor vectors.
    """
    counted = term_counts(texts, X.tokens_of(query)).select(*KEYS, "language", "name", "dl", "tf")
    near = dense(vectors.select("chunk_id", "vector"), vector).select("chunk_id", "dense")
    return written(counted.join(near, "chunk_id"), "narrow")


def fused(scored: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Ranks, rrf, the three maxima and the fused score."""
    df = V.global_rank(scored, "dense", KEYS, "dense_rank")
    df = V.global_rank(df, "bm25", KEYS, "bm25_rank")
    share = lambda r: F.coalesce(F.lit(1.0) / (F.lit(float(s.rrf_k)) + F.col(r)), F.lit(0.0))
    df = df.withColumn("rrf", share("dense_rank") + share("bm25_rank"))
    top = df.agg(F.max("dense").alias("top_dense"), F.max("bm25").alias("top_bm25"), F.max("rrf").alias("top_rrf"))
    df = df.crossJoin(F.broadcast(top))  # one row
    n = {c: V.normalise(F.col(c), F.col(f"top_{c}")) for c in ("dense", "bm25", "rrf")}
    return df.withColumn("fused", s.dense_weight * n["dense"] + s.bm25_weight * n["bm25"] + s.rrf_weight * n["rrf"]).drop("top_dense", "top_bm25", "top_rrf")


def boosted(score: Column, hit: Column, s: Settings = Settings()) -> Column:
    """the identifier boost, then the clamp."""
    up = F.when(hit, F.greatest(score * s.boost, F.lit(s.boost * s.boost_floor))).otherwise(score)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), up))


def search(corpus: DataFrame, query: str, vector: DataFrame | list[float] | None = None, languages: list[str] | None = None, prefix: str | None = None, s: Settings = Settings()) -> DataFrame:
    """V1-V3: the best hit of each file, by score.

    ``corpus`` has repo, file_path, byte_start, chunk_id, language, name, content and (unless lexical only)
    vector, or comes from ``narrowed`` for the same query. Content is not in the result; it is fetched for the few hits by whoever shows them. Ties end in file order.
    """
    tokens = X.tokens_of(query)
    df = dense(bm25(term_counts(filtered(corpus, languages, prefix), tokens), tokens, s), vector)
    hit = X.name_hit(F.col("name"), tokens)
    return ranked(df.withColumn("ident", hit).select(*KEYS, "dense", "bm25", "ident"), s)


def ranked(scored: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The best hit of each file of scored chunks (keys, dense, bm25, ident), by score."""
    # ranks and maxima read the scores several times
    df = fused(written(scored, "scores"), s)
    df = df.withColumn("score", F.round(boosted(F.col("fused"), F.col("ident"), s), 6))
    df = df.where(((F.col("bm25") > 0) | F.col("ident") | (F.col("dense") >= s.similarity_threshold)) & (F.col("score") >= s.min_score))
    first = Window.partitionBy("repo", "file_path").orderBy(F.desc("score"), "byte_start", "chunk_id")
    df = df.withColumn("__first", F.row_number().over(first)).where("__first = 1").drop("__first")
    top = df.orderBy(F.desc("score"), *KEYS).limit(s.top_k)
    best = Window.orderBy(F.desc("score"), *KEYS)  # at most top_k rows
    return top.withColumn("rank", F.row_number().over(best)).select("rank", "repo", X.parent_dir(F.col("file_path")).alias("directory"), "file_path", "chunk_id", "dense", "bm25", "score")


def grouped(hits: DataFrame) -> DataFrame:
    """Groups by repo and directory in the order of their best hit, with their hits."""
    hit = F.struct("rank", "file_path", "chunk_id", "score")
    groups = hits.groupBy("repo", "directory").agg(F.min("rank").alias("best"), F.array_sort(F.collect_list(hit)).alias("hits"))
    return groups.orderBy("best")


def stale(hits: DataFrame, files: DataFrame, most: int = 512 * 1024) -> DataFrame:
    """Hits with whether their file is gone, too large, or changed since it was indexed.

    Hits are few (``Settings.top_k``); they go to the files, and no file is exchanged.
    """
    hits = written(hits, "hits")
    now = files.select("repo", "file_path", F.col("file_hash").alias("__hash"), F.col("size").alias("__size"))
    now = now.join(F.broadcast(hits.select("repo", "file_path").distinct()), ["repo", "file_path"], "left_semi")
    out = hits.join(now, ["repo", "file_path"], "left")
    return out.withColumn("stale", F.col("__hash").isNull() | (F.col("__hash") != F.col("file_hash")) | (F.col("__size") > most)).drop("__hash", "__size")
