"""The catalogue of reference-style queries over the test tables, with the same results in DuckDB SQL.

Adapter views: repo and language are documents.lang, file is source, content is text, a document's vector is
the embedding of its id; for vector-only queries the label is the file and vec_id the chunk; for the edit queue
the event type is the path, the user the session. Doubles are rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import commands
from lodestone.functions import text as X
from lodestone.functions import vectors as V
from lodestone.functions.hashing import xxh3_128
from lodestone.operators import chunking, evaluation, hints, overview, ranges, similarity, store
from lodestone.plans import postings
from lodestone.plans import search as S
from lodestone.scratch import few, fresh, written
from lodestone.sources.files import union_repos
from lodestone.streaming import queue as Q

QUERY = "hent hest"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as a query of its name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- search --------------------------------------------------------------------------------------


def corpus(spark: SparkSession, sf_dir: str, vectors: bool = True, named: bool = False) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("repo"), F.col("source").alias("file_path"), F.lit(0).alias("byte_start"), F.col("doc_id").alias("chunk_id"), F.col("lang").alias("language"),
        (F.regexp_extract("text", r"^(\S*)", 1) if named else F.lit(None).cast("string")).alias("name"), F.col("text").alias("content"),
    )
    if not vectors:
        return docs.withColumn("vector", F.lit(None).cast("array<float>"))
    return docs.join(vectors_of(spark, sf_dir), "chunk_id")


def vectors_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))


def narrow(spark: SparkSession, sf_dir: str, named: bool = False) -> DataFrame:
    """The corpus for QUERY and the first vector: texts and vectors are read where they lie, and not joined."""
    return S.narrowed(corpus(spark, sf_dir, vectors=False, named=named), vectors_of(spark, sf_dir), QUERY, first_vector(spark, sf_dir))


def first_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding")


def search_sql(where: str = "true", dense: str | None = "greatest(list_cosine_similarity(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 0)", named: bool = False) -> str:
    """The search plan as CTEs up to ``top``, the ranked hits."""
    source = "documents d JOIN embeddings e ON e.vec_id = d.doc_id" if dense else "documents d"
    ident = "(" + " OR ".join(f"contains(translate(coalesce(name, ''), '{X.UPPER}', '{X.LOWER}'), '{t}')" for t in X.tokens_of(QUERY)) + ")" if named else "false"
    name = "regexp_extract(text, '^(\\S*)', 1)" if named else "NULL::VARCHAR"
    return f"""
WITH q AS (SELECT unnest({X.tokens_of(QUERY)!r}) AS tok),
f AS (
  SELECT d.lang AS repo, d.source AS file_path, d.doc_id AS chunk_id, {name} AS name,
    list_transform(regexp_extract_all(d.text, '[A-Za-z0-9]+'), lambda x: lower(x)) AS toks, round({dense or '0::DOUBLE'}, 6)::DOUBLE AS dense
  FROM {source} WHERE {where}),
st AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM f),
tf AS (SELECT chunk_id, tok, len(list_filter(toks, lambda x: x = tok)) AS tf, len(toks) AS dl FROM f, q),
df AS (SELECT tok, count(*) AS df FROM tf WHERE tf > 0 GROUP BY 1),
b AS (
  SELECT chunk_id, round(sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * greatest(dl, 1) / greatest(avgdl, 1)))), 6) AS bm25
  FROM tf JOIN df USING (tok), st WHERE tf > 0 GROUP BY 1),
s AS (SELECT f.repo, f.file_path, f.chunk_id, name, dense, coalesce(bm25, 0)::DOUBLE AS bm25 FROM f LEFT JOIN b USING (chunk_id)),
r1 AS (SELECT chunk_id, row_number() OVER (ORDER BY dense DESC, repo, file_path, chunk_id) AS r FROM s WHERE dense > 0),
r2 AS (SELECT chunk_id, row_number() OVER (ORDER BY bm25 DESC, repo, file_path, chunk_id) AS r FROM s WHERE bm25 > 0),
rr AS (SELECT s.*, r1.r AS dense_rank, r2.r AS bm25_rank, coalesce(1::DOUBLE / (60 + r1.r), 0) + coalesce(1::DOUBLE / (60 + r2.r), 0) AS rrf FROM s LEFT JOIN r1 USING (chunk_id) LEFT JOIN r2 USING (chunk_id)),
mx AS (SELECT max(dense) AS md, max(bm25) AS mb, max(rrf) AS mr FROM rr),
n AS (
  SELECT rr.*, CASE WHEN md > 0 THEN dense / md ELSE 0 END AS nd, CASE WHEN mb > 0 THEN bm25 / mb ELSE 0 END AS nb, CASE WHEN mr > 0 THEN rrf / mr ELSE 0 END AS nr, {ident} AS ident FROM rr, mx),
fu AS (SELECT *, 0.55::DOUBLE * nd + 0.30::DOUBLE * nb + 0.15::DOUBLE * nr AS fused FROM n),
g AS (SELECT *, round(least(1, greatest(0, CASE WHEN ident THEN greatest(fused * 1.4::DOUBLE, 0.42::DOUBLE) ELSE fused END)), 6)::DOUBLE AS score FROM fu),
w AS (SELECT *, row_number() OVER (PARTITION BY repo, file_path ORDER BY score DESC, chunk_id) AS rn FROM g WHERE (bm25 > 0 OR ident OR dense >= 0.3) AND score >= 0.05),
top AS (SELECT row_number() OVER (ORDER BY score DESC, repo, file_path, chunk_id) AS rank, repo, CASE WHEN file_path LIKE '%/%' THEN regexp_extract(file_path, '^(.*)/[^/]*$', 1) ELSE '.' END AS directory, file_path, chunk_id, dense, bm25, score
  FROM w WHERE rn = 1 QUALIFY rank <= 10)
"""


@query(search_sql() + "SELECT * FROM top")
def search_hybrid(spark, sf_dir):
    """V1, V2."""
    return S.search(narrow(spark, sf_dir), QUERY, first_vector(spark, sf_dir))


@query(search_sql("d.lang IN ('en', 'fr')") + "SELECT * FROM top")
def search_lang_filter(spark, sf_dir):
    return S.search(narrow(spark, sf_dir), QUERY, first_vector(spark, sf_dir), languages=["en", "fr"])


@query(search_sql("(d.source = 'src1' OR starts_with(d.source, 'src1/') OR (starts_with(d.source, 'src1.') AND NOT regexp_matches(substr(d.source, 6), '[/.]')))") + "SELECT * FROM top")
def search_path_prefix(spark, sf_dir):
    return S.search(narrow(spark, sf_dir), QUERY, first_vector(spark, sf_dir), prefix="src1/")


@query(search_sql(dense=None) + "SELECT * FROM top")
def search_lexical_degraded(spark, sf_dir):
    """V3."""
    return S.search(corpus(spark, sf_dir, vectors=False), QUERY)


@query(search_sql("d.lang IN ('en', 'de', 'fr', 'es')") + "SELECT * FROM top")
def search_multi_repo(spark, sf_dir):
    """A repository for each language, and one that can't be read."""
    c = narrow(spark, sf_dir)
    loaders = {lang: lambda lang=lang: c.where(F.col("repo") == lang) for lang in ("en", "de", "fr", "es")}
    rows, _ = union_repos(loaders | {"none": lambda: table(spark, sf_dir, "no_such_table")})
    return S.search(rows.drop("repo_ord"), QUERY, first_vector(spark, sf_dir))


@query(search_sql() + "SELECT rank, t.repo, t.file_path, t.chunk_id, t.chunk_id % 3 = 0 OR t.chunk_id % 7 = 0 OR length(text) > 3000 AS stale FROM top t JOIN documents ON doc_id = t.chunk_id")
def search_stale(spark, sf_dir):
    """Hits whose file is gone, too large or changed; here each chunk is a file of its own."""
    rows = corpus(spark, sf_dir, vectors=False)
    digest = lambda c: F.md5(c.cast("binary"))
    now = F.when(F.col("chunk_id") % 7 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content"))
    files = rows.where("chunk_id % 3 <> 0").select("repo", F.col("chunk_id").cast("string").alias("file_path"), digest(now).alias("file_hash"), F.length("content").alias("size"))
    hits = F.broadcast(S.search(narrow(spark, sf_dir), QUERY, first_vector(spark, sf_dir)))  # at most top_k rows
    hits = rows.select("chunk_id", digest(F.col("content")).alias("file_hash")).join(hits, "chunk_id")
    shown = hits.withColumns({"shown": F.col("file_path"), "file_path": F.col("chunk_id").cast("string")})
    return S.stale(shown, files, 3000).select("rank", "repo", F.col("shown").alias("file_path"), "chunk_id", "stale")


@query(search_sql(named=True) + "SELECT * FROM top")
def identifier_boost(spark, sf_dir):
    """F2, F36."""
    return S.search(narrow(spark, sf_dir, named=True), QUERY, first_vector(spark, sf_dir))


@query(search_sql() + "SELECT repo, directory, min(rank) AS best, string_agg(chunk_id::VARCHAR, ',' ORDER BY rank) AS hits FROM top GROUP BY 1, 2")
def search_grouped_by_dir(spark, sf_dir):
    """W6, F3."""
    hits = S.search(narrow(spark, sf_dir), QUERY, first_vector(spark, sf_dir))
    ids = F.array_join(F.transform("hits", lambda h: h["chunk_id"].cast("string")), ",")
    return S.grouped(hits).select("repo", "directory", "best", ids.alias("hits"))


@query(search_sql() + "SELECT chunk_id, dense_rank, bm25_rank, round(rrf, 6) AS rrf FROM rr")
def rrf_ranks(spark, sf_dir):
    """W1, F33."""
    tokens = X.tokens_of(QUERY)
    scored = S.bm25(narrow(spark, sf_dir), tokens)
    return S.fused(written(scored, "scores")).select("chunk_id", "dense_rank", "bm25_rank", F.round("rrf", 6).alias("rrf"))


@query(search_sql() + "SELECT chunk_id, round(nd, 6) AS nd, round(nb, 6) AS nb, round(nr, 6) AS nr, round(fused, 6) AS fused FROM fu")
def max_normalise(spark, sf_dir):
    """A6, F34, F35."""
    tokens = X.tokens_of(QUERY)
    df = S.fused(written(S.bm25(narrow(spark, sf_dir), tokens), "scores"))
    top = df.agg(F.max("dense").alias("md"), F.max("bm25").alias("mb"), F.max("rrf").alias("mr"))
    df = df.crossJoin(F.broadcast(top))
    part = lambda c, m: F.round(V.normalise(F.col(c), F.col(m)), 6)
    return df.select("chunk_id", part("dense", "md").alias("nd"), part("bm25", "mb").alias("nb"), part("rrf", "mr").alias("nr"), F.round("fused", 6).alias("fused"))


@query(search_sql(dense=None) + "SELECT chunk_id, bm25 FROM s")
def bm25_scores(spark, sf_dir):
    """A1-A4, F32."""
    tokens = X.tokens_of(QUERY)
    return S.bm25(S.term_counts(corpus(spark, sf_dir, vectors=False), tokens), tokens).select("chunk_id", "bm25")


def stored(spark, sf_dir, named: bool = False) -> postings.Postings:
    return postings.Postings(spark, fresh(spark, "postings"), 32).build(corpus(spark, sf_dir, vectors=False, named=named))


@query(search_sql(dense=None) + "SELECT * FROM top")
def stored_lexical(spark, sf_dir):
    """V3, J10, A1-A4 from stored postings."""
    return stored(spark, sf_dir).search(QUERY)


@query(search_sql("d.lang IN ('en', 'fr')", named=True) + "SELECT * FROM top")
def stored_hybrid(spark, sf_dir):
    """V1, V2, P1, F36 from stored postings and a scan of the vectors alone."""
    c = corpus(spark, sf_dir, named=True)
    index = postings.Postings(spark, fresh(spark, "postings"), 32).build(c)
    return index.search(QUERY, first_vector(spark, sf_dir), c.drop("content"), languages=["en", "fr"])


@query(search_sql(dense=None) + "SELECT repo, file_path, 0 AS byte_start, chunk_id, bm25 FROM s WHERE bm25 > 0 ORDER BY bm25 DESC, repo, file_path, chunk_id LIMIT 10")
def stored_top(spark, sf_dir):
    """The best chunks, without the parts of lists that cannot hold one."""
    return stored(spark, sf_dir).top(QUERY, 10)


TOKENS = "list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"


@query(f"SELECT doc_id, tok, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, unnest(t) AS tok, len(t) AS dl FROM (SELECT doc_id, {TOKENS} AS t FROM documents)) GROUP BY 1, 2")
def term_stats(spark, sf_dir):
    """A1: texts are exchanged by their document, and its tokens are counted where it is; no token is a row of an exchange."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id").select("doc_id", X.tokenize(F.col("text")).alias("t"))
    rows = docs.select("doc_id", F.size("t").cast("long").alias("dl"), F.explode("t").alias("tok"))
    return rows.groupBy("doc_id", "tok").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


@query(f"SELECT tok, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TOKENS}) AS tok FROM documents) GROUP BY 1")
def doc_freq(spark, sf_dir):
    """Distinct within a row first, so that no distinct aggregate is needed."""
    docs = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(X.tokenize(F.col("text")))).alias("tok"))
    return docs.groupBy("tok").agg(F.count("*").alias("df"))


@query("SELECT doc_id, CASE WHEN len(t) > 0 THEN t[1] END AS first_token, len(t) AS n_tokens FROM (SELECT doc_id, " + TOKENS + " AS t FROM documents)")
def tokenize(spark, sf_dir):
    """F1."""
    t = table(spark, sf_dir, "documents").select("doc_id", X.tokenize(F.col("text")).alias("t"))
    return t.select("doc_id", F.get("t", F.lit(0)).alias("first_token"), F.size("t").cast("long").alias("n_tokens"))


GENERIC = ", ".join(repr(s) for s in X.GENERIC_SYMBOLS)


# -- vectors -------------------------------------------------------------------------------------

VEC = "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings) "


def vectors(spark: SparkSession, sf_dir: str, file: str = "label") -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.pmod("vec_id", F.lit(3)).cast("int").alias("repo"), F.col(file).alias("file_path"), F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))


def some_vectors(spark, sf_dir, ids) -> list[list[float]]:
    rows = table(spark, sf_dir, "embeddings").where(F.col("vec_id").isin(ids)).orderBy("vec_id").select(V.doubles(F.col("embedding")).alias("v")).collect()
    return [list(r.v) for r in rows]


@query(VEC + "SELECT vec_id, round(greatest(list_cosine_similarity(e, (SELECT e FROM v WHERE vec_id = 0)), 0), 6) AS dense FROM v ORDER BY dense DESC, vec_id LIMIT 10")
def search_vector_only(spark, sf_dir):
    """J1, T3, A15, F30, F31."""
    out = S.dense(vectors(spark, sf_dir), first_vector(spark, sf_dir)).select(F.col("chunk_id").alias("vec_id"), "dense")
    return out.orderBy(F.desc("dense"), "vec_id").limit(10)


def _pairs_sql(where: str) -> str:
    key = "(repo, label, vec_id)"
    return f"""WITH v AS (SELECT vec_id, label, (vec_id % 3)::INT AS repo, embedding::DOUBLE[] AS e FROM embeddings)
SELECT a.repo AS a_repo, a.label AS a_file, a.vec_id AS a_chunk, b.repo AS b_repo, b.label AS b_file, b.vec_id AS b_chunk, round(list_cosine_similarity(a.e, b.e), 6) AS similarity
FROM v a JOIN v b ON (a.repo, a.label, a.vec_id) < (b.repo, b.label, b.vec_id) AND {where} WHERE list_cosine_similarity(a.e, b.e) >= 0.4
ORDER BY similarity DESC, a_repo, a_file, a_chunk, b_repo, b_file, b_chunk LIMIT 50"""


@query(_pairs_sql("(a.repo <> b.repo OR a.label <> b.label)"))
def dup_pairs(spark, sf_dir):
    """J2, P8, P9, T4, V4."""
    return similarity.duplicate_pairs(vectors(spark, sf_dir), 0.4, cap=None)


@query(_pairs_sql("a.repo <> b.repo"))
def dup_pairs_cross_repo(spark, sf_dir):
    return similarity.duplicate_pairs(vectors(spark, sf_dir), 0.4, cap=None, cross_repo=True)


def _near_sql(ids: str, tail: str, where: str = "label <> 0") -> str:
    return (
        VEC + f"""SELECT file_path, chunk_id, score FROM (
  SELECT label AS file_path, vec_id AS chunk_id, score, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rn
  FROM (SELECT v.label, v.vec_id, round(greatest(max(list_cosine_similarity(v.e, q.e)), 0), 6) AS score FROM v, v q WHERE q.vec_id IN ({ids}) AND v.{where} GROUP BY 1, 2)) WHERE rn = 1 {tail}"""
    )


@query(_near_sql("0", "AND score >= 0.1 ORDER BY score DESC, file_path LIMIT 5"))
def neighbors_single(spark, sf_dir):
    """V5, P5, A5, T5."""
    own = similarity.neighbours(vectors(spark, sf_dir), some_vectors(spark, sf_dir, [0]), F.col("file_path") == 0, 5, 0.1)
    return own.select("file_path", "chunk_id", "score")


@query(_near_sql("0, 1, 2", "AND score >= 0.2 ORDER BY score DESC, file_path LIMIT 5"))
def neighbors_multi(spark, sf_dir):
    """The maximum over several queries."""
    own = similarity.neighbours(vectors(spark, sf_dir), some_vectors(spark, sf_dir, [0, 1, 2]), F.col("file_path") == 0, 5, 0.2)
    return own.select("file_path", "chunk_id", "score")


@query(_near_sql("0", "ORDER BY score DESC, file_path LIMIT 65") + "")
def neighbors_depth(spark, sf_dir):
    """Over-fetched; files of score 0 stay."""
    depth = similarity.RELATED_TOP_K * similarity.RELATED_DEPTH
    own = similarity.neighbours(vectors(spark, sf_dir), some_vectors(spark, sf_dir, [0]), F.col("file_path") == 0, depth, 0.0)
    return own.select("file_path", "chunk_id", "score")


FLOOR = VEC + """, m AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k, count(*) OVER (PARTITION BY label) AS n FROM v),
seed AS (SELECT label, e FROM m WHERE k = n // 2),
best AS (SELECT s.label, round(greatest(max(list_cosine_similarity(s.e, v.e)), 0), 6) AS best FROM seed s JOIN v ON v.label <> s.label GROUP BY 1),
r AS (SELECT best, row_number() OVER (ORDER BY best) AS r, count(*) OVER () AS n FROM best) """


@query(FLOOR + "SELECT 30 AS p, best AS value FROM r WHERE r = greatest(1, (n * 30 + 99) // 100)")
def corpus_floor_p30(spark, sf_dir):
    """V6, A13, W3-W5."""
    return similarity.nearest_rank(similarity.best_neighbours(vectors(spark, sf_dir)), "best", [30])


@query(FLOOR + "SELECT p, best AS value FROM r, (SELECT unnest([10, 15, 20, 25, 30, 35, 40])::INT AS p) WHERE r = greatest(1, (n * p + 99) // 100)")
def floor_sweep(spark, sf_dir):
    """E6."""
    return similarity.nearest_rank(similarity.best_neighbours(vectors(spark, sf_dir)), "best", [10, 15, 20, 25, 30, 35, 40])


@query(FLOOR + "SELECT p, best AS value FROM r, (SELECT unnest([10, 25, 50, 75, 90, 100])::INT AS p) WHERE r = greatest(1, (n * p + 99) // 100)")
def score_distribution(spark, sf_dir):
    """E3."""
    return similarity.nearest_rank(similarity.best_neighbours(vectors(spark, sf_dir)), "best", [10, 25, 50, 75, 90, 100])


@query("SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AS ok FROM embeddings")
def validate_vectors(spark, sf_dir):
    """F60, P31."""
    return table(spark, sf_dir, "embeddings").select("vec_id", V.valid(F.col("embedding"), 64).alias("ok"))


EDITS = VEC + "SELECT e.vec_id // 100 AS edit, v.label AS file_path, round(greatest(max(list_cosine_similarity(v.e, e.e)), 0), 6) AS score FROM v e JOIN v ON v.label <> e.label WHERE e.vec_id % 100 = 0 GROUP BY 1, 2"


def edits(spark, sf_dir, least: float = 0.0) -> DataFrame:
    """Every hundredth vector is an edit; each meets the best chunk of every other file."""
    e = table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.floor(F.col("vec_id") / 100).alias("edit"), F.col("label").alias("own"), F.col("embedding").alias("vector"))
    return similarity.scores(vectors(spark, sf_dir), e, least)


@query(EDITS)
def neighbor_scores(spark, sf_dir):
    """E2, J3."""
    return edits(spark, sf_dir)


@query("WITH p AS (" + EDITS + "), s AS (SELECT edit, count(*) AS n FROM p WHERE score >= 0.25 GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n) AS r, count(*) OVER () AS c FROM s) SELECT max(n) AS largest, round(avg(n), 6) AS mean, count(*) FILTER (n > 5) AS over_cap, (SELECT n FROM r WHERE r.r = greatest(1, (c * 90 + 99) // 100)) AS p90 FROM s")
def pool_stats(spark, sf_dir):
    """A19."""
    return evaluation.pool_stats(evaluation.pool(edits(spark, sf_dir, 0.25), 0.25), 5)


@query("WITH p AS (" + EDITS + "), h AS (SELECT edit, file_path, row_number() OVER (PARTITION BY edit ORDER BY score DESC, file_path) AS r FROM p), x AS (SELECT edit, avg((file_path % 2 = edit % 2)::INT::DOUBLE) AS p, max(CASE WHEN r = 1 THEN (file_path % 2 = edit % 2)::INT::DOUBLE END) AS p1 FROM h WHERE r <= 3 GROUP BY 1) SELECT round(avg(p), 6) AS p_at_k, round(avg(p1), 6) AS p_at_1, 0.5::DOUBLE AS base, round(avg(p) / 0.5, 6) AS lift FROM x")
def precision_at_k(spark, sf_dir):
    """Relevance by parity, to have a fixed truth."""
    hits = evaluation.pool(edits(spark, sf_dir)).withColumns({"relevant": (F.pmod("file_path", F.lit(2)) == F.pmod("edit", F.lit(2))).cast("int"), "base": F.lit(0.5)})
    return evaluation.precision(hits, 3)


REPLAY = (
    "WITH RECURSIVE p AS (" + EDITS + "), h AS (SELECT edit, file_path, row_number() OVER (PARTITION BY edit ORDER BY score DESC, file_path) AS rank FROM p), "
    "l AS (SELECT edit, edit // 10 AS session, list(file_path ORDER BY rank) AS every FROM h GROUP BY edit), o AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY edit) AS k FROM l), "
    "r AS (SELECT session, k, edit, every[1:3] AS shown, every[1:3] AS seen, [every[1:3]::VARCHAR] AS lists, false AS repeated, false AS starved FROM o WHERE k = 1 UNION ALL "
    "SELECT session, k, edit, shown, list_concat(seen, shown), list_append(lists, shown::VARCHAR), len(shown) > 0 AND list_contains(lists, shown::VARCHAR), len(shown) = 0 AND len(list_filter(every[4:], lambda x: NOT list_contains(seen, x))) > 0 "
    "FROM (SELECT o.session, o.k, o.edit, o.every, list_filter(o.every[1:3], lambda x: NOT list_contains(r.seen, x)) AS shown, r.seen, r.lists FROM o JOIN r ON o.session = r.session AND o.k = r.k + 1)) "
)


@query(REPLAY + "SELECT session, edit, unnest(CASE WHEN len(shown) = 0 THEN [NULL] ELSE shown END) AS file_path, repeated, starved FROM r")
def session_replay(spark, sf_dir):
    """E4."""
    return evaluation.replay(evaluation.pool(edits(spark, sf_dir)), 1, 3)


@query(
    "WITH RECURSIVE p AS (" + EDITS + "), h AS (SELECT edit, file_path, row_number() OVER (PARTITION BY edit ORDER BY score DESC, file_path) AS rank FROM p), "
    "l AS (SELECT edit, edit // 10 AS session, list(file_path ORDER BY rank) AS every FROM h GROUP BY edit), o AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY edit) AS k FROM l), d AS (SELECT unnest([1, 3, 5])::INT AS depth), "
    "r AS (SELECT depth, session, k, edit, every[1:5] AS shown, every[1:5] AS seen, [every[1:5]::VARCHAR] AS lists, false AS repeated, false AS starved FROM o, d WHERE k = 1 UNION ALL "
    "SELECT depth, session, k, edit, shown, list_concat(seen, shown), list_append(lists, shown::VARCHAR), len(shown) > 0 AND list_contains(lists, shown::VARCHAR), len(shown) = 0 AND len(list_filter(every[5 * depth + 1:], lambda x: NOT list_contains(seen, x))) > 0 "
    "FROM (SELECT r.depth, o.session, o.k, o.edit, o.every, list_filter(o.every[1:5 * r.depth], lambda x: NOT list_contains(r.seen, x))[1:5] AS shown, r.seen, r.lists FROM o JOIN r ON o.session = r.session AND o.k = r.k + 1)), "
    "f AS (SELECT depth, f, count(*) AS n FROM (SELECT depth, unnest(shown) AS f FROM r) GROUP BY 1, 2), g AS (SELECT depth, arg_max(f, (n, f)) AS hub, count(*) AS files FROM f GROUP BY 1) "
    "SELECT sum(len(shown))::BIGINT AS emitted, (SELECT count(DISTINCT edit) FROM p) - count(*) FILTER (len(shown) > 0) AS silent, count(*) FILTER (repeated) AS repeated_lists, count(*) FILTER (starved) AS starved, hub, files, depth FROM r JOIN g USING (depth) GROUP BY hub, files, depth"
)
def depth_sweep(spark, sf_dir):
    """E5, A18, A20."""
    pools = written(evaluation.pool(edits(spark, sf_dir)), "pools")
    return evaluation.depth_sweep(pools, pools.select("edit").distinct().count(), (1, 3, 5))


@query(
    "WITH d AS (SELECT source AS file_path, doc_id AS chunk_id, regexp_extract(text, '^(\\S*)', 1) AS name, text, embedding::DOUBLE[] AS e FROM documents JOIN embeddings ON vec_id = doc_id), "
    "w AS (SELECT DISTINCT file_path, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS symbol FROM d), "
    "p AS (SELECT a.chunk_id AS edit, b.file_path, round(greatest(max(list_cosine_similarity(a.e, b.e)), 0), 6) AS score FROM d a JOIN d b ON a.file_path <> b.file_path WHERE a.chunk_id % 100 = 0 GROUP BY 1, 2), "
    "h AS (SELECT *, row_number() OVER (PARTITION BY edit ORDER BY score DESC, file_path) AS rank FROM p), "
    "t AS (SELECT d.chunk_id AS edit, d.name AS symbol, count(*) AS files FROM d JOIN w ON w.symbol = d.name AND w.file_path <> d.file_path WHERE strlen(d.name) >= 4 AND d.name NOT IN (GENERIC) GROUP BY 1, 2), "
    "x AS (SELECT h.edit, files, avg((w.symbol IS NOT NULL)::INT::DOUBLE) AS p, max(CASE WHEN rank = 1 THEN (w.symbol IS NOT NULL)::INT::DOUBLE END) AS p1 FROM h JOIN t USING (edit) LEFT JOIN w ON w.symbol = t.symbol AND w.file_path = h.file_path WHERE rank <= 3 GROUP BY 1, 2), "
    "y AS (SELECT *, files / greatest((SELECT count(DISTINCT file_path) FROM d) - 1, 1)::DOUBLE AS b FROM x) "
    "SELECT count(*) AS evaluated, round(avg(p), 6) AS p_at_k, round(avg(p1), 6) AS p_at_1, round(avg(b), 6) AS base, round(CASE WHEN avg(b) > 0 THEN avg(p) / avg(b) ELSE 0 END, 6) AS lift, count(*) FILTER (files <= 3) AS rare, round(avg(p) FILTER (files <= 3), 6) AS rare_p_at_k, round(avg(b) FILTER (files <= 3), 6) AS rare_base FROM y".replace("GENERIC", GENERIC)
)
def symbol_precision(spark, sf_dir):
    """Each document's first word is its symbol; edits are every hundredth."""
    c = corpus(spark, sf_dir, named=True)
    e = c.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("edit"), F.col("file_path").alias("own"), "vector")
    return evaluation.symbol_precision(c, evaluation.pool(similarity.scores(c, e)), 3)


@query(
    "WITH p AS (" + EDITS + "), n AS (SELECT DISTINCT vec_id // 100 AS edit FROM embeddings WHERE vec_id % 100 = 0), h AS (SELECT *, row_number() OVER (PARTITION BY edit ORDER BY score DESC, file_path) AS rank FROM p), "
    "o AS (SELECT n.edit, coalesce(max(score), 0) AS best, coalesce(max(score) FILTER (rank = 3), 0) AS kth FROM n LEFT JOIN h USING (edit) GROUP BY 1), "
    "r AS (SELECT *, row_number() OVER (ORDER BY best) AS rb, row_number() OVER (ORDER BY kth) AS rk, count(*) OVER () AS c FROM o) "
    "SELECT count(*) AS edits, count(*) FILTER (best >= 0.3) AS some, round(100.0::DOUBLE * count(*) FILTER (best >= 0.3) / count(*), 6) AS some_pct, count(*) FILTER (kth >= 0.3) AS every, round(100.0::DOUBLE * count(*) FILTER (kth >= 0.3) / count(*), 6) AS every_pct, "
    + ", ".join(f"max({c}) FILTER ({r} = greatest(1, (c * {p} + 99) // 100))::DOUBLE AS {c}_p{p}" for c, r, at in (("best", "rb", (10, 25, 50, 75, 90, 100)), ("kth", "rk", (10, 50, 90, 100))) for p in at)
    + " FROM r"
)
def score_report(spark, sf_dir):
    """The spread of best and third scores, and what a floor of 0.3 leaves."""
    asked = table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.floor(F.col("vec_id") / 100).alias("edit"))
    return evaluation.score_report(evaluation.pool(edits(spark, sf_dir)), asked, 3, 0.3)


@query(
    "WITH d AS (SELECT source AS file_path, doc_id AS chunk_id, regexp_extract(text, '^(\\S*)', 1) AS name, text, embedding::DOUBLE[] AS e FROM documents JOIN embeddings ON vec_id = doc_id), "
    "w AS (SELECT DISTINCT file_path, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS symbol FROM d), "
    "p AS (SELECT a.chunk_id AS edit, b.file_path, round(greatest(max(list_cosine_similarity(a.e, b.e)), 0), 6) AS score FROM d a JOIN d b ON a.file_path <> b.file_path WHERE a.chunk_id % 100 = 0 GROUP BY 1, 2), "
    "h AS (SELECT *, row_number() OVER (PARTITION BY edit ORDER BY score DESC, file_path) AS rank FROM p), "
    "t AS (SELECT d.chunk_id AS edit, d.name AS symbol FROM d JOIN w ON w.symbol = d.name AND w.file_path <> d.file_path WHERE strlen(d.name) >= 4 AND d.name NOT IN (GENERIC) GROUP BY 1, 2), "
    "j AS (SELECT h.edit, h.rank, h.score, (w.symbol IS NOT NULL)::INT::DOUBLE AS there FROM h JOIN t USING (edit) LEFT JOIN w ON w.symbol = t.symbol AND w.file_path = h.file_path WHERE rank <= 3), "
    "b AS (SELECT score AS best, row_number() OVER (ORDER BY score) AS r, count(*) OVER () AS c FROM h WHERE rank = 1), "
    "f AS (SELECT p, best AS floor, c FROM b, (SELECT unnest([10, 20, 30, 40])::INT AS p) WHERE r = greatest(1, (c * p + 99) // 100)), "
    "v AS (SELECT f.p, f.floor, f.c, h.edit, count(*) FILTER (score >= floor AND rank <= 3) AS kept FROM f, h GROUP BY ALL), "
    "q AS (SELECT f.p, j.edit, avg(there) FILTER (score >= floor) AS pr, max(there) FILTER (score >= floor AND rank = 1) AS p1 FROM f, j GROUP BY ALL), "
    "a AS (SELECT p, floor, 100.0::DOUBLE * count(*) FILTER (kept > 0) / any_value(c) AS clear, sum(kept)::DOUBLE / any_value(c) AS per_edit FROM v GROUP BY 1, 2), "
    "z AS (SELECT p, 100.0::DOUBLE * count(pr) / count(*) AS cover, avg(pr) AS precision, sum(p1) / count(pr) AS precision_1 FROM q GROUP BY 1) "
    "SELECT p, floor, round(clear, 6) AS clear, round(per_edit, 6) AS per_edit, round(coalesce(cover, 0), 6) AS cover, round(coalesce(precision, 0), 6) AS precision, round(coalesce(precision_1, 0), 6) AS precision_1 FROM a LEFT JOIN z USING (p)".replace("GENERIC", GENERIC)
)
def floor_report(spark, sf_dir):
    """Floors at four percentiles, with the volume and the precision of the hints that they let through."""
    c = corpus(spark, sf_dir, named=True)
    e = c.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("edit"), F.col("file_path").alias("own"), "vector")
    pools = written(evaluation.pool(similarity.scores(c, e)), "pools")
    return evaluation.floor_report(pools, evaluation.judged(c, pools, 3), e, [10, 20, 30, 40], 3)


# -- overview ------------------------------------------------------------------------------------

PATHS = "SELECT doc_id, lang || '/' || source || '.md' AS file_path, lang AS language, text FROM documents"


def paths(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "lang", F.concat("source", F.lit(".md"))).alias("file_path"), F.col("lang").alias("language"), "text")


@query("WITH p AS (" + PATHS + ") SELECT regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS directory, count(DISTINCT file_path) AS file_count, count(*) AS chunk_count FROM p GROUP BY 1")
def overview_rollup(spark, sf_dir):
    """V7, A7, A8."""
    return overview.rollup(paths(spark, sf_dir)).select("directory", "file_count", "chunk_count")


@query("WITH p AS (" + PATHS + "), d AS (SELECT regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS d, count(DISTINCT file_path) AS f, count(*) AS n FROM p GROUP BY 1) SELECT sum(f)::BIGINT AS file_count, sum(n)::BIGINT AS chunk_count, count(*) AS directories FROM d")
def overview_totals(spark, sf_dir):
    """A9."""
    return overview.totals(overview.rollup(paths(spark, sf_dir)))


@query("SELECT '.' AS directory, string_agg(lang || ':' || n, ',' ORDER BY n DESC, lang) AS languages FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)")
def overview_languages(spark, sf_dir):
    """T8."""
    flat = paths(spark, sf_dir).withColumn("file_path", F.col("language"))
    named = F.array_join(F.transform("languages", lambda x: F.concat_ws(":", x["language"], x["chunk_count"].cast("string"))), ",")
    return overview.rollup(flat).select("directory", named.alias("languages"))


# -- index maintenance ---------------------------------------------------------------------------

NOW = "SELECT doc_id::VARCHAR AS file_path, md5(text) AS file_hash FROM documents WHERE doc_id % 13 <> 0"
OLD = "SELECT doc_id::VARCHAR AS file_path, CASE WHEN doc_id % 11 = 0 THEN md5('x' || text) ELSE md5(text) END AS file_hash FROM documents WHERE doc_id % 7 <> 0"


def states(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The current files and a derived earlier state."""
    d = table(spark, sf_dir, "documents")
    path = F.col("doc_id").cast("string").alias("file_path")
    now = d.where("doc_id % 13 <> 0").select(path, F.md5(F.col("text").cast("binary")).alias("file_hash"))
    old = F.when(F.col("doc_id") % 11 == 0, F.md5(F.concat(F.lit("x"), "text").cast("binary"))).otherwise(F.md5(F.col("text").cast("binary")))
    return now, d.where("doc_id % 7 <> 0").select(path, old.alias("file_hash"))


CHANGED = f"WITH now AS ({NOW}), old AS ({OLD}), ch AS (SELECT now.* FROM now LEFT JOIN old USING (file_path) WHERE old.file_hash IS NULL OR old.file_hash <> now.file_hash), orp AS (SELECT old.* FROM old ANTI JOIN now USING (file_path)) "


@query(CHANGED + "SELECT * FROM ch")
def index_diff(spark, sf_dir):
    """J4."""
    return store.changed_files(*states(spark, sf_dir))


@query(CHANGED + "SELECT * FROM orp")
def orphans(spark, sf_dir):
    """J5, J8, S20."""
    now, old = states(spark, sf_dir)
    return store.orphans(old, now)


@query(CHANGED + "SELECT file_path FROM ch UNION ALL SELECT file_path FROM orp")
def stale_union(spark, sf_dir):
    """X3."""
    return store.stale(*states(spark, sf_dir))


@query(CHANGED + "SELECT file_path FROM old SEMI JOIN now USING (file_path) ANTI JOIN ch USING (file_path)")
def preserved_files(spark, sf_dir):
    """X4."""
    return store.preserved(*states(spark, sf_dir))


@query(f"WITH now AS ({NOW}), old AS ({OLD}) SELECT count(*) FILTER (now.file_hash IS DISTINCT FROM old.file_hash) AS differing, count(*) AS paths, count(*) FILTER (now.file_hash IS DISTINCT FROM old.file_hash) = 0 AND count(*) > 0 AS in_sync FROM now FULL JOIN old USING (file_path)")
def manifest_match(spark, sf_dir):
    """J6."""
    return store.matches(*states(spark, sf_dir))


@query(CHANGED + "SELECT * FROM old ANTI JOIN orp USING (file_path)")
def prune_missing(spark, sf_dir):
    """S20."""
    now, old = states(spark, sf_dir)
    return store.delete_paths(old, store.orphans(old, now))


@query(CHANGED + "SELECT * FROM old ANTI JOIN ch USING (file_path) UNION ALL SELECT * FROM ch")
def upsert_file(spark, sf_dir):
    """S16, S18."""
    now, old = states(spark, sf_dir)
    return store.upsert(old, store.changed_files(now, old))


@query(CHANGED + "SELECT * FROM old ANTI JOIN ch USING (file_path)")
def delete_paths(spark, sf_dir):
    """S15."""
    now, old = states(spark, sf_dir)
    return store.delete_paths(old, store.changed_files(now, old))


@query(CHANGED + "SELECT file_path FROM now ANTI JOIN old USING (file_path)")
def forced_without_chunks(spark, sf_dir):
    """J7."""
    now, old = states(spark, sf_dir)
    return store.orphans(now, old).select("file_path")


@query("WITH c AS (SELECT source AS file_path, md5(text) AS content_hash, doc_id FROM documents) SELECT doc_id, file_path FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.doc_id % 3 = 0 AND b.file_path = a.file_path AND b.content_hash = a.content_hash)")
def changed_chunks(spark, sf_dir):
    """P16, X6."""
    c = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("file_path"), F.md5(F.col("text").cast("binary")).alias("content_hash"))
    return ranges.changed(c, c.where("doc_id % 3 = 0")).select("doc_id", "file_path")


RANGES = "SELECT doc_id, source AS file_path, n_chars % 300 AS byte_start, n_chars % 300 + n_chars % 90 AS byte_end FROM documents"


@query(f"WITH r AS ({RANGES}) SELECT doc_id, file_path, byte_start, byte_end FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE a.file_path = b.file_path AND b.byte_start >= a.byte_start AND b.byte_end <= a.byte_end AND (b.byte_start, b.byte_end) <> (a.byte_start, a.byte_end))")
def innermost_changed(spark, sf_dir):
    """P12, P13, J12."""
    r = table(spark, sf_dir, "documents").selectExpr("doc_id", "source AS file_path", "n_chars % 300 AS byte_start", "n_chars % 300 + n_chars % 90 AS byte_end")
    return ranges.innermost(r).select("doc_id", "file_path", "byte_start", "byte_end")


LINES = "SELECT event_id, event_type AS file_path, user_id AS name, event_id % 211 AS line_start, event_id % 211 + event_id % 17 AS line_end FROM events"


def lines(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id", "event_type AS file_path", "user_id AS name", "event_id % 211 AS line_start", "event_id % 211 + event_id % 17 AS line_end")


def _unseen_sql(keys: list[str]) -> str:
    same = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    return f"WITH r AS ({LINES}) SELECT event_id FROM r a WHERE event_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM r b WHERE b.event_id % 2 = 1 AND {same} AND b.line_start <= a.line_start AND b.line_end >= a.line_end)"


@query(_unseen_sql(["file_path", "name"]))
def range_seen_filter(spark, sf_dir):
    """Seen by file and name."""
    r = lines(spark, sf_dir)
    return ranges.unseen(r.where("event_id % 2 = 0"), r.where("event_id % 2 = 1"), ["file_path", "name"]).select("event_id")


@query(_unseen_sql(["file_path"]))
def range_read_filter(spark, sf_dir):
    """Read by file."""
    r = lines(spark, sf_dir)
    return ranges.unseen(r.where("event_id % 2 = 0"), r.where("event_id % 2 = 1"), ["file_path"]).select("event_id")


@query(f"WITH r AS ({LINES}) SELECT event_id FROM r WHERE line_start <= 120 AND line_end >= 100")
def range_overlap(spark, sf_dir):
    """P10."""
    return lines(spark, sf_dir).where(ranges.overlaps(F.col("line_start"), F.col("line_end"), F.lit(100), F.lit(120))).select("event_id")


# -- the store -----------------------------------------------------------------------------------


def document_chunks(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("doc_id is not null")
    return d.select(
        F.col("lang").alias("repo"), F.concat_ws("/", "source", (F.col("doc_id") % 97).cast("string")).alias("file_path"), F.lit(0).cast("long").alias("byte_start"), F.col("n_chars").cast("long").alias("byte_end"),
        F.lit(1).cast("long").alias("line_start"), F.lit(1).cast("long").alias("line_end"), F.col("doc_id").alias("chunk_id"), F.col("lang").alias("language"), F.lit("other").alias("kind"), F.lit(None).cast("string").alias("name"),
        F.md5(F.col("source").cast("binary")).cast("binary").alias("file_hash"), F.col("text").alias("content"), F.array(F.lit(1.0).cast("float"), F.col("n_chars").cast("float")).alias("vector"),
    )


def filled_store(spark, sf_dir) -> store.Store:
    """A store that all chunks went to in two appends, in which every third file was replaced by its first chunk and every fifth deleted."""
    out, rows = store.Store(spark, fresh(spark, "store"), 8), document_chunks(spark, sf_dir)
    out.append(rows.where("chunk_id % 2 = 0"), 2)
    out.append(rows.where("chunk_id % 2 = 1"), 2)
    out.write_manifest(store.Manifest("stub", 2))
    third = rows.where("CAST(element_at(split(file_path, '/'), -1) AS INT) % 3 = 0")
    least = few(written(third.groupBy("file_path").agg(F.min("chunk_id").alias("chunk_id")), "least"))
    firsts = third.join(least, ["file_path", "chunk_id"], "left_semi")
    out.replace(firsts.select(*store.CHUNKS.fieldNames()), 2)
    out.delete(rows.where("CAST(element_at(split(file_path, '/'), -1) AS INT) % 5 = 0").select("file_path"))
    return out


STORE = "WITH r AS (SELECT source || '/' || (doc_id % 97)::VARCHAR AS file_path, doc_id % 97 AS k, doc_id AS chunk_id, lang AS language, n_chars, text, source FROM documents WHERE doc_id IS NOT NULL), s AS (SELECT * FROM r WHERE k % 5 <> 0 AND (k % 3 <> 0 OR chunk_id = (SELECT min(chunk_id) FROM r x WHERE x.file_path = r.file_path))) "


@query(STORE + "SELECT file_path, chunk_id, n_chars AS byte_end, md5(text) AS content FROM s")
def store_rows(spark, sf_dir):
    """What a store gives back after appends, a replacement and a deletion."""
    return filled_store(spark, sf_dir).rows().select("file_path", "chunk_id", "byte_end", F.md5(F.col("content").cast("binary")).alias("content"))


@query(STORE + "SELECT count(*) AS chunks, count(DISTINCT file_path) AS files, count(DISTINCT file_path || language) AS pairs FROM s")
def store_counts(spark, sf_dir):
    """Counts by metadata and paths; the manifest's are the same, or there is no row."""
    own = filled_store(spark, sf_dir)
    m = own.manifest()
    out = own.metadata().agg(F.count("*").alias("chunks"), F.countDistinct("file_path").alias("files"), F.countDistinct(F.concat("file_path", "language")).alias("pairs"))
    return out.where((F.col("chunks") == m.chunk_count) & (F.col("files") == own.paths().count()) & F.lit(own.in_step()))


@query(STORE + "SELECT file_path, md5(any_value(source)) AS file_hash FROM s GROUP BY 1")
def store_hashes(spark, sf_dir):
    """The hashes of all files that are left."""
    return filled_store(spark, sf_dir).files().select("file_path", F.col("file_hash").cast("string").alias("file_hash"))


EDITED = "(SELECT min(file_path) FROM s)"


@query(STORE + f", t AS (SELECT file_path, chunk_id, n_chars, md5(text) AS content FROM s WHERE file_path <> {EDITED} UNION ALL SELECT file_path, max(chunk_id) + 1, 6, md5('edited') FROM s WHERE file_path = {EDITED} GROUP BY 1) SELECT file_path, chunk_id, n_chars AS byte_end, content, (SELECT count(*) FROM t) AS chunks, (SELECT count(DISTINCT file_path) FROM t) AS files FROM t")
def store_after_edit(spark, sf_dir):
    """One file is edited: its bucket alone is read and written, and rows taken before are still there to read."""
    own = filled_store(spark, sf_dir)
    before = own.rows()
    path = before.agg(F.min("file_path").alias("file_path"))
    edited = before.join(F.broadcast(path), "file_path", "left_semi").groupBy("file_path").agg(F.max(F.struct("chunk_id", *(c for c in store.CHUNKS.fieldNames() if c not in ("chunk_id", "file_path")))).alias("r"))
    rows = edited.select("file_path", "r.*").withColumns({"chunk_id": F.col("chunk_id") + 1, "byte_end": F.lit(6).cast("long"), "content": F.lit("edited")})
    own.replace(rows.select(*store.CHUNKS.fieldNames()), 2)
    m = own.manifest()
    out = own.rows().select("file_path", "chunk_id", "byte_end", F.md5(F.col("content").cast("binary")).alias("content"))
    out = out.withColumns({"chunks": F.lit(m.chunk_count).cast("long"), "files": F.lit(m.file_count).cast("long")})
    return out.where(F.lit(before.count() > 0))


@query("WITH r AS (SELECT source || '/' || (doc_id % 97)::VARCHAR AS file_path, doc_id % 97 AS k, doc_id AS chunk_id FROM documents WHERE doc_id IS NOT NULL), s AS (SELECT * FROM r WHERE k % 3 = 0 OR k % 3 = 1 AND chunk_id = (SELECT min(chunk_id) FROM r x WHERE x.file_path = r.file_path)) SELECT file_path, chunk_id, (SELECT count(*) FROM s) AS chunks, (SELECT count(DISTINCT file_path) FROM s) AS files FROM s")
def store_two_writers(spark, sf_dir):
    """Two writers at once, one that replaces a third of the files and one that deletes another; neither loses the other's work."""
    from concurrent.futures import ThreadPoolExecutor

    top, rows = fresh(spark, "store"), document_chunks(spark, sf_dir)
    store.Store(spark, top, 8).append(rows, 2)
    store.Store(spark, top, 8).write_manifest(store.Manifest("stub", 2))
    k = "CAST(element_at(split(file_path, '/'), -1) AS INT) % 3"
    third = rows.where(f"{k} = 1")
    least = few(written(third.groupBy("file_path").agg(F.min("chunk_id").alias("chunk_id")), "least"))
    firsts = third.join(least, ["file_path", "chunk_id"], "left_semi").select(*store.CHUNKS.fieldNames())
    with ThreadPoolExecutor(2) as pool:
        jobs = [pool.submit(store.Store(spark, top, 8).replace, firsts, 2), pool.submit(store.Store(spark, top, 8).delete, rows.where(f"{k} = 2").select("file_path"))]
        for j in jobs:
            j.result()
    own = store.Store(spark, top, 8)
    m = own.manifest()
    return own.rows().select("file_path", "chunk_id", F.lit(m.chunk_count).cast("long").alias("chunks"), F.lit(m.file_count).cast("long").alias("files"))


# -- hints ---------------------------------------------------------------------------------------

#: Command lines and the patterns that they search for.
COMMANDS = [
    ("rg foo", "foo"), ("grep -n 'two words'", "two words"), ("git grep foo", "foo"), ("git log foo", None), ("time nice rg foo", "foo"), ("stdbuf -oL rg foo", "foo"), ("env A=1 ag foo", "foo"),
    ("rg foo src", None), ("rg -l foo", None), ("rg --count foo", None), ("rg -e foo", "foo"), ("rg -e foo -e bar", None), ("rg --regexp=foo", "foo"), ("rg -t py foo", "foo"), ("rg -- -foo", "-foo"), ("rg 'unclosed", None),
]


def _rows(rows: list[tuple]) -> str:
    """SQL values."""
    one = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


@query(f"SELECT event_id, command, pattern FROM events JOIN (VALUES {_rows([(k, *c) for k, c in enumerate(COMMANDS)])}) c(k, command, pattern) ON k = event_id % {len(COMMANDS)}")
def search_commands(spark, sf_dir):
    """P20: patterns of command lines, against a table of what they are."""
    lines = F.array(*(F.lit(c) for c, _ in COMMANDS))
    e = table(spark, sf_dir, "events").select("event_id", F.get(lines, (F.col("event_id") % len(COMMANDS)).cast("int")).alias("command"))
    return e.select("event_id", "command", commands.searched(F.col("command")).alias("pattern"))


NEAR = "SELECT event_id, user_id::VARCHAR AS session, 'f' || (event_id % 40) || '.py' AS edited_path, 'f' || (event_id % 37) || (CASE WHEN event_id % 4 = 0 THEN '.md' ELSE '.py' END) AS file_path, 'n' || (event_id % 3) AS name, event_id % 50 AS line_start, event_id % 50 + event_id % 7 AS line_end, round((event_id % 101) / 100::DOUBLE, 2) AS score FROM events"


@query(
    f"WITH n AS ({NEAR}), f AS (SELECT DISTINCT file_path FROM n WHERE event_id % 10 <> 0), "
    "k AS (SELECT * FROM n a WHERE event_id % 2 = 0 AND file_path <> edited_path AND file_path IN (SELECT file_path FROM f) "
    "AND NOT EXISTS (SELECT 1 FROM n b WHERE b.event_id % 6 = 1 AND b.session = a.session AND b.file_path = a.file_path AND b.name = a.name AND b.line_start <= a.line_start AND b.line_end >= a.line_end) "
    "AND NOT EXISTS (SELECT 1 FROM n b WHERE b.event_id % 6 = 3 AND b.session = a.session AND b.file_path = a.file_path AND b.line_start <= a.line_start AND b.line_end >= a.line_end)), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY session, edited_path ORDER BY score DESC, file_path, line_start, line_end) AS rank FROM k QUALIFY rank <= 5) "
    "SELECT session, edited_path, rank, file_path, line_start, line_end, score, file_path LIKE '%.md' AS is_doc FROM r"
)
def related_hints(spark, sf_dir):
    """What is shown of neighbours: not the own file, nor what is gone, seen or read."""
    e = table(spark, sf_dir, "events")
    ext = F.when(F.col("event_id") % 4 == 0, F.lit(".md")).otherwise(F.lit(".py"))
    n = e.select(
        "event_id", F.col("user_id").cast("string").alias("session"), F.concat(F.lit("f"), (F.col("event_id") % 40).cast("string"), F.lit(".py")).alias("edited_path"), F.concat(F.lit("f"), (F.col("event_id") % 37).cast("string"), ext).alias("file_path"),
        F.concat(F.lit("n"), (F.col("event_id") % 3).cast("string")).alias("name"), (F.col("event_id") % 50).alias("line_start"), (F.col("event_id") % 50 + F.col("event_id") % 7).alias("line_end"), F.round((F.col("event_id") % 101).cast("double") / 100, 2).alias("score"),
    )
    files = n.where("event_id % 10 <> 0").select("file_path").distinct()
    return hints.fresh(n.where("event_id % 2 = 0").drop("event_id"), n.where("event_id % 6 = 1"), n.where("event_id % 6 = 3"), files, 5).drop("name")


# -- the queue -----------------------------------------------------------------------------------

QUEUE = "SELECT epoch_us(ts) // 1000 AS ts, event_type || '/' || (event_id % 50)::VARCHAR AS path, CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id::VARCHAR END AS session, event_id AS seq FROM events"
CUT = 1705000000000


def edit_queue(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    path = F.concat_ws("/", "event_type", (F.col("event_id") % 50).cast("string"))
    session = F.when(F.col("event_id") % 5 != 0, F.col("user_id").cast("string"))
    return e.select(F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), path.alias("path"), session.alias("session"), F.col("event_id").alias("seq"))


@query(f"WITH q AS ({QUEUE}) SELECT path, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS edits FROM q GROUP BY 1")
def queue_collapse(spark, sf_dir):
    """A11."""
    return Q.collapse(edit_queue(spark, sf_dir))


DUE = f"WITH q AS ({QUEUE}), d AS (SELECT path, least(max(ts) + 10000, min(ts) + 60000) AS deadline FROM q WHERE ts > {CUT} GROUP BY 1) "


@query(DUE + f"SELECT path, deadline FROM d WHERE deadline <= {CUT} + 80000000")
def queue_due(spark, sf_dir):
    """R1."""
    return Q.due(edit_queue(spark, sf_dir).where(F.col("ts") > CUT), CUT + 80_000_000).select("path", "deadline")


@query(DUE + f"SELECT min(deadline) AS deadline FROM d WHERE deadline > {CUT} + 80000000")
def queue_next_deadline(spark, sf_dir):
    """A12."""
    return Q.next_deadline(edit_queue(spark, sf_dir).where(F.col("ts") > CUT), CUT + 80_000_000)


@query(f"WITH q AS ({QUEUE}) SELECT path, session FROM q QUALIFY row_number() OVER (PARTITION BY path ORDER BY ts DESC, seq DESC) = 1")
def queue_latest_session(spark, sf_dir):
    """J14."""
    return Q.latest_session(edit_queue(spark, sf_dir))


@query(f"WITH q AS ({QUEUE}), d AS (SELECT path, max(ts) AS upto FROM q WHERE ts <= {CUT} GROUP BY 1) SELECT seq FROM q LEFT JOIN d USING (path) WHERE upto IS NULL OR ts > upto")
def queue_drain_survivors(spark, sf_dir):
    """R2."""
    q = edit_queue(spark, sf_dir)
    return Q.drained(q, Q.collapse(q.where(F.col("ts") <= CUT))).select("seq")


@query(f"WITH q AS ({QUEUE}) SELECT path, min(seq) AS seq FROM q GROUP BY 1")
def queue_distinct_paths(spark, sf_dir):
    """A24."""
    return Q.distinct_paths(edit_queue(spark, sf_dir))


def _streamed(spark: SparkSession, sf_dir: str, shape: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a streaming plan over the events as a file source until it has read all; its output as a table."""
    at = fresh(spark, "stream")
    schema = table(spark, sf_dir, "events").schema
    out = shape(spark.readStream.schema(schema).option("pathGlobFilter", "*events*").option("recursiveFileLookup", True).parquet(sf_dir))
    q = out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out")


@query(f"WITH q AS ({QUEUE}) SELECT path, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS edits, arg_max(session, (ts, seq)) FILTER (session IS NOT NULL) AS session FROM q GROUP BY 1")
def queue_stream(spark, sf_dir):
    """The queue as logs that a stream reads by bytes: each path's edits and its last named session."""
    from lodestone.sources import queue_log

    at = fresh(spark, "queue")
    q = edit_queue(spark, sf_dir)
    q.orderBy("seq").select(Q.format_line(F.col("ts"), F.col("path"), F.col("session")).alias("value")).write.text(f"{at}/logs")
    rows = Q.parse(queue_log.stream(spark, f"{at}/logs", 1 << 16), keep=["log", "upto"])
    query = rows.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.schema(rows.schema).parquet(f"{at}/out")
    named = F.max(F.when(F.col("session").isNotNull(), F.struct("ts", "log", "upto", "session")))
    return out.groupBy("path").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("edits"), named.alias("n")).select("path", "first_seen", "last_seen", "edits", F.col("n.session").alias("session"))


#: Events as edits by a clock two hundred times as fast, in order by path.
FAST = "SELECT event_type AS path, epoch_us(ts) // 200000 AS ms FROM events"


def _fast(e: DataFrame) -> DataFrame:
    return e.select(F.col("event_type").alias("path"), F.timestamp_millis(F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 200)).alias("ts"))


@query(
    f"WITH RECURSIVE e AS (SELECT path, ms, row_number() OVER (PARTITION BY path ORDER BY ms) AS k FROM ({FAST})), "
    "r AS (SELECT path, k, ms AS first, ms AS last, 1::BIGINT AS n, 1::BIGINT AS round FROM e WHERE k = 1 UNION ALL "
    "SELECT path, k, CASE WHEN done THEN ms ELSE first END, ms, CASE WHEN done THEN 1 ELSE n + 1 END, round + done::INT FROM (SELECT e.path, e.k, e.ms, r.first, r.n, r.round, e.ms >= least(r.last + 10000, r.first + 60000) AS done FROM r JOIN e ON e.path = r.path AND e.k = r.k + 1)), "
    "t AS (SELECT path, round, min(first) AS first_seen, max(last) AS last_seen, count(*) AS edits, max(round) OVER (PARTITION BY path) AS final FROM r GROUP BY path, round) "
    "SELECT path, first_seen, last_seen, edits FROM t WHERE round < final OR least(last_seen + 10000, first_seen + 60000) <= (SELECT max(ms) - 60000 FROM e)"
)
def stream_debounce(spark, sf_dir):
    """R1 as a stream: rounds that a later edit closes, and those due by the watermark."""
    from lodestone.streaming import state

    return _streamed(spark, sf_dir, lambda e: state.debounced(_fast(e)))


SESSIONS = "SELECT event_id, user_id::VARCHAR AS session, event_type, event_type = 'signup' AS start, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS epoch FROM events"


@query(
    f"WITH h AS (SELECT *, event_type AS file_path, 'n' || event_id % 2 AS name, event_id % 211 AS line_start, event_id % 211 + event_id % 17 AS line_end FROM ({SESSIONS})) "
    "SELECT session, file_path, name, line_start, line_end FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.session = a.session AND b.epoch = a.epoch AND b.file_path = a.file_path AND b.name = a.name AND b.event_id < a.event_id AND b.line_start <= a.line_start AND b.line_end >= a.line_end)"
)
def stream_seen_dedup(spark, sf_dir):
    """R6, R8 as a stream; a signup begins its user's session anew."""
    from lodestone.streaming import state

    hint = ["CAST(user_id AS STRING) AS session", "event_id AS seq", "event_type = 'signup' AS start", "event_type AS file_path", "concat('n', event_id % 2) AS name", "event_id % 211 AS line_start", "event_id % 211 + event_id % 17 AS line_end"]
    return _streamed(spark, sf_dir, lambda e: state.suppressed(e.selectExpr(*hint), None))


@query(
    f"WITH h AS (SELECT *, event_type AS file_path, greatest(event_id % 307, 1) AS line_start, greatest(event_id % 307, 1) + least(CASE WHEN event_id % 5 = 4 THEN 2000 ELSE event_id % 23 END, 2000) - 1 AS line_end FROM ({SESSIONS}) WHERE event_id % 5 = 4 OR event_id % 23 > 0) "
    "SELECT session, file_path, line_start, line_end FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.session = a.session AND b.epoch = a.epoch AND b.file_path = a.file_path AND b.event_id < a.event_id AND b.line_start <= a.line_start AND b.line_end >= a.line_end)"
)
def stream_read_windows(spark, sf_dir):
    """R7, R8 as a stream: windows that a session has not covered yet; every fifth read has no limit."""
    from lodestone.streaming import state

    read = ["CAST(user_id AS STRING) AS session", "event_id AS seq", "event_type = 'signup' AS start", "event_type AS file_path", "event_id % 307 AS offset", "CASE WHEN event_id % 5 <> 4 THEN event_id % 23 END AS `limit`"]
    return _streamed(spark, sf_dir, lambda e: state.read_windows(e.selectExpr(*read), None))


@query(
    "WITH RECURSIVE e AS (SELECT event_type AS repo, 'p' || user_id % 7 AS path, epoch_us(ts) // 5000000 AS ms FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ms, path) AS k FROM e), "
    "r AS (SELECT repo, k, ms AS start, path FROM o WHERE k = 1 UNION ALL SELECT o.repo, o.k, CASE WHEN o.ms >= r.start + 250 THEN o.ms ELSE r.start END, o.path FROM r JOIN o ON o.repo = r.repo AND o.k = r.k + 1), "
    "w AS (SELECT repo, start, path, min(k) AS k, count(*) AS n FROM r GROUP BY ALL) "
    "SELECT repo, start, row_number() OVER (PARTITION BY repo, start ORDER BY k) - 1 AS place, path, n FROM w WHERE start < (SELECT max(start) FROM r x WHERE x.repo = w.repo) OR start + 250 <= (SELECT max(ms) - 1000 FROM e)"
)
def watch_windows(spark, sf_dir):
    """R3 as a stream: windows of 250 ms from their first event, by a clock five thousand times as fast."""
    from lodestone.streaming import state

    def shape(e: DataFrame) -> DataFrame:
        ts = F.timestamp_millis(F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 5000)).alias("ts")
        return state.windows(e.select(F.col("event_type").alias("repo"), F.concat(F.lit("p"), (F.col("user_id") % 7).cast("string")).alias("path"), ts), late="1 second")

    return _streamed(spark, sf_dir, shape)


# -- scalars -------------------------------------------------------------------------------------


@query("SELECT event_id, ts < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 24 HOUR AS stale FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def freshness(spark, sf_dir):
    """P25, F50, F51."""
    e = table(spark, sf_dir, "events").select("event_id", X.rfc3339(F.col("ts").cast("timestamp")).alias("at"))
    return e.select("event_id", overview.freshness(F.col("at"), F.lit("2024-01-15 00:00:00").cast("timestamp")).alias("stale"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, epoch(date_trunc('second', ts))::BIGINT AS seconds FROM events")
def rfc3339_roundtrip(spark, sf_dir):
    """F50, F51."""
    e = table(spark, sf_dir, "events").select("event_id", X.rfc3339(F.col("ts").cast("timestamp")).alias("at"))
    return e.withColumn("seconds", F.unix_timestamp(X.parse_rfc3339(F.col("at"))))


@query("WITH d AS (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS p FROM documents) SELECT doc_id, array_to_string(p[1:3], chr(10)) || CASE WHEN len(p) > 3 THEN chr(10) || '…' ELSE '' END AS snippet FROM d")
def snippet(spark, sf_dir):
    """T10, F9, P29."""
    return table(spark, sf_dir, "documents").select("doc_id", X.snippet(F.col("text"), 3).alias("snippet"))


@query("SELECT page_id, CASE WHEN url LIKE '%/%' THEN regexp_extract(url, '^(.*)/[^/]*$', 1) ELSE '.' END AS dir FROM pages")
def parent_dir(spark, sf_dir):
    """F3."""
    return table(spark, sf_dir, "pages").select("page_id", X.parent_dir(F.col("url")).alias("dir"))


NAMES = ["README", "a/readme.MD", "src/x.rs", "b.txt", "LICENSE.bak", "docs/guide.Org", "x", "a/b.c/changelog"]


@query(f"SELECT doc_id, name, CASE WHEN contains(b, '.') THEN regexp_extract(b, '^.*\\.([^.]*)$', 1) IN {X.DOC_EXTENSIONS!r} ELSE b IN {X.DOC_NAMES!r} END AS is_doc FROM (SELECT doc_id, name, lower(regexp_extract(name, '([^/]*)$', 1)) AS b FROM (SELECT doc_id, ({NAMES!r})[doc_id % {len(NAMES)} + 1] AS name FROM documents))")
def doc_file(spark, sf_dir):
    """P18, F13."""
    names = F.array(*(F.lit(n) for n in NAMES))
    d = table(spark, sf_dir, "documents").select("doc_id", F.get(names, (F.col("doc_id") % len(NAMES)).cast("int")).alias("name"))
    return d.select("doc_id", "name", X.is_doc_file(F.col("name")).alias("is_doc"))


FILES = ["a.rs", "b/c.py", "d.tsx", "e.PY", "Makefile", ".rs", "f.tar.go", "g.hpp", "h.cs", "i.jsx", "j.sql", "k.md"]


@query("SELECT doc_id, name, coalesce(map_extract_value(MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in X.EXTENSIONS.items()) + f"}}, regexp_extract(regexp_extract(name, '([^/]*)$', 1), '^.+\\.([^.]*)$', 1)), 'unknown') AS language FROM (SELECT doc_id, ({FILES!r})[doc_id % {len(FILES)} + 1] AS name FROM documents)")
def language_of_ext(spark, sf_dir):
    """F5, F25."""
    names = F.array(*(F.lit(n) for n in FILES))
    d = table(spark, sf_dir, "documents").select("doc_id", F.get(names, (F.col("doc_id") % len(FILES)).cast("int")).alias("name"))
    return d.select("doc_id", "name", X.language_of(F.col("name")).alias("language"))


TARGET = " OR ".join(f"contains(text, '{p}')" for p in ("--glob", "--include", "*.", "src/", ".rs", ".py", ".js", ".mjs", ".cjs", ".ts", ".tsx", ".go", ".java", ".c", ".h", ".cpp", ".cc", ".cxx", ".hpp", ".hxx", ".cs", ".sql"))


@query(r"SELECT doc_id, trim(text) = '' OR regexp_matches(text, '[\^$\\\[\]()+?{}]|\.\*') OR " + TARGET + r" OR len(regexp_extract_all(text, '[\p{L}\p{N}]+')) < 3 AS pass FROM documents")
def passthrough(spark, sf_dir):
    """P19, F10-F12."""
    return table(spark, sf_dir, "documents").select("doc_id", X.passthrough(F.col("text")).alias("pass"))




@query(f"WITH w AS (SELECT DISTINCT doc_id, source, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS s FROM documents), sym AS (SELECT s, min(source) AS home FROM w WHERE strlen(s) >= 4 AND s NOT IN ({GENERIC}) GROUP BY 1) SELECT s AS symbol, count(DISTINCT doc_id) AS mentions, count(DISTINCT source) AS files FROM w JOIN sym USING (s) WHERE source <> home GROUP BY 1")
def symbol_mentions(spark, sf_dir):
    """Identifiers and the other files that mention them, by an inverted index."""
    return evaluation.mentions(table(spark, sf_dir, "documents").select(F.col("source").alias("file_path"), F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")))


@query("SELECT doc_id, substr(sha256(source), 1, 16) AS suffix, NOT regexp_matches(text, '[\\t\\n]') AS safe FROM documents")
def session_suffix(spark, sf_dir):
    """F23, F26."""
    return table(spark, sf_dir, "documents").select("doc_id", X.session_suffix(F.col("source")).alias("suffix"), X.ledger_safe(F.col("text")).alias("safe"))


@query("SELECT o_orderkey, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' || (s % 60) || 's' ELSE (s // 3600) || 'h' || (s % 3600 // 60) || 'm' END AS elapsed FROM (SELECT o_orderkey, o_orderkey % 20000 AS s FROM orders)")
def format_elapsed(spark, sf_dir):
    """F54."""
    return table(spark, sf_dir, "orders").select("o_orderkey", X.format_elapsed(F.col("o_orderkey") % 20000).alias("elapsed"))


@query("SELECT event_id, (props->>'$.k')::INT AS k FROM events WHERE event_type IN ('view', 'click') AND (props->>'$.k') IS NOT NULL")
def payload_fields(spark, sf_dir):
    """F63, P23, P26."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click"))
    return e.select("event_id", F.from_json("props", "k int")["k"].alias("k")).where("k is not null")


@query("SELECT 'en' AS repo, 0 AS repo_ord, count(*) AS n FROM documents WHERE lang = 'en' UNION ALL SELECT 'fr', 1, count(*) FROM documents WHERE lang = 'fr'")
def cross_repo_union(spark, sf_dir):
    """A repository that fails is left out."""
    d = lambda lang: lambda: table(spark, sf_dir, "documents").where(F.col("lang") == lang)
    frame, _ = union_repos({"en": d("en"), "fr": d("fr"), "none": lambda: table(spark, sf_dir, "no_such_table")})
    return frame.groupBy("repo", "repo_ord").agg(F.count("*").alias("n"))


@query("SELECT 'none' AS repo, true AS failed")
def repo_errors(spark, sf_dir):
    """Errors are rows."""
    _, errors = union_repos({"en": lambda: table(spark, sf_dir, "documents"), "none": lambda: table(spark, sf_dir, "no_such_table")})
    return spark.createDataFrame([(r, bool(e)) for r, e in errors], "repo string, failed boolean")


# -- SQL text ------------------------------------------------------------------------------------


def in_sql(spark, sf_dir, text: str) -> DataFrame:
    """A query in SQL text over the library's functions; {documents} and the like are tables."""
    from lodestone.functions import sql

    sql.register(spark)
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in ("documents", "embeddings") if "{" + t + "}" in text})


@query(ORACLE_SQL["tokenize"])
def sql_tokens(spark, sf_dir):
    """F1 in SQL text."""
    return in_sql(spark, sf_dir, "SELECT doc_id, get(t, 0) AS first_token, CAST(size(t) AS BIGINT) AS n_tokens FROM (SELECT doc_id, tokenize(text) AS t FROM {documents})")


@query(ORACLE_SQL["search_vector_only"])
def sql_cosine(spark, sf_dir):
    """F30, F31, J1 in SQL text."""
    own = "SELECT vec_id, CAST(embedding AS ARRAY<DOUBLE>) AS e FROM {embeddings}"
    return in_sql(spark, sf_dir, f"WITH q AS (SELECT e FROM ({own}) WHERE vec_id = 0) SELECT vec_id, round(greatest(cosine(v.e, q.e), 0D), 6) AS dense FROM ({own}) v JOIN q ON true ORDER BY dense DESC, vec_id LIMIT 10")


@query("SELECT doc_id, source = 'src1' OR starts_with(source, 'src1/') OR (starts_with(source, 'src1.') AND NOT regexp_matches(substr(source, 6), '[/.]')) AS below, snippet FROM documents JOIN (" + ORACLE_SQL["snippet"] + ") USING (doc_id)")
def sql_snippet(spark, sf_dir):
    """P2, T10 in SQL text."""
    return in_sql(spark, sf_dir, "SELECT doc_id, path_prefix(source, 'src1/') AS below, snippet(text, 3) AS snippet FROM {documents}")


@query()
def sql_windows(spark, sf_dir):
    """K0, K10 in SQL text: a table function with LATERAL."""
    return in_sql(spark, sf_dir, "SELECT doc_id, w.byte_start, w.byte_end, w.line_start, w.line_end, sha2(w.content, 256) AS digest FROM {documents}, LATERAL text_windows(text, 12, 2) w")


# -- chunks, vectors and hashes (no SQL) ---------------------------------------------------------


def document_files(spark, sf_dir, language: str = "unknown") -> DataFrame:
    d = table(spark, sf_dir, "documents")
    body = F.col("text").cast("binary")
    return d.select(F.col("lang").alias("repo"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("rel_path"), F.lit(language).alias("language"), xxh3_128(body).alias("file_hash"), F.lit(True).alias("force_indexed"), body.alias("content"))


@query()
def chunk_text(spark, sf_dir):
    """K0, K10, F19-F22, W7, W8, W12."""
    return chunking.chunks(document_files(spark, sf_dir)).select("file_path", "byte_start", "byte_end", "line_start", "line_end", "chunk_id", "kind")


@query(
    "WITH d AS (SELECT 'f_' || doc_id::VARCHAR AS f, length(doc_id::VARCHAR) AS n FROM documents), c AS (SELECT f, 12 AS s, 35 + n AS e, 'function' AS kind, f AS name FROM d UNION ALL SELECT f, 38 + n, 76 + n, 'class', 'C' FROM d "
    "UNION ALL SELECT f, 51 + n, 76 + n, 'function', 'm' FROM d) SELECT f || '.py' AS file_path, s::BIGINT AS byte_start, e::BIGINT AS byte_end, kind, name FROM c"
)
def chunk_python(spark, sf_dir):
    """K2: each document's first word as a function of a module."""
    d = table(spark, sf_dir, "documents")
    word = F.concat(F.lit("f_"), F.col("doc_id").cast("string"))
    code = F.concat(F.lit("import os\n\n\ndef "), word, F.lit("(x):\n    return x\n\n\nclass C:\n    def m(self):\n        pass\n")).cast("binary")
    files = d.select(F.col("lang").alias("repo"), F.concat(word, F.lit(".py")).alias("rel_path"), F.lit("python").alias("language"), xxh3_128(code).alias("file_hash"), F.lit(False).alias("force_indexed"), code.alias("content"))
    return chunking.chunks(files).select("file_path", "byte_start", "byte_end", "kind", "name")


@query()
def embed_stub(spark, sf_dir):
    """U1, U5."""
    from lodestone.functions.embedding import Stub, embed

    return table(spark, sf_dir, "documents").select("doc_id", embed(F.col("text"), Stub()).alias("vector"))


@query()
def hash_xxh3(spark, sf_dir):
    """F18, F20."""
    return table(spark, sf_dir, "documents").select("doc_id", F.lower(F.hex(xxh3_128(F.col("text").cast("binary")))).alias("digest"))
