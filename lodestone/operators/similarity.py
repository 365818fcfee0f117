"""Near-duplicate pairs, neighbours of edits, and the corpus floor, by matrix products over blocks and Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators import blocks as B
from lodestone.operators.blocks import unit_rows
from lodestone.operators.ranks import nearest_rank, placed

#: Defaults and limits.
DUPLICATES_MIN, DUPLICATES_LIMIT, DUPLICATES_CAP = 0.85, 50, 50_000
RELATED_TOP_K, RELATED_MIN, RELATED_DEPTH = 5, 0.80, 13
FLOOR_PERCENTILE, FLOOR_MIN_FILES, FLOOR_MAX_CHUNKS, FLOOR_MAX_SEEDS = 30, 8, 100_000, 400


class TooManyChunks(ValueError):
    """The corpus is above the limit for exact pairs."""


def _width(rows: DataFrame) -> int:
    return rows.agg(F.max(F.size("vector"))).first()[0] or 1


def duplicate_pairs(corpus: DataFrame, least: float = DUPLICATES_MIN, limit: int | None = DUPLICATES_LIMIT, cap: int | None = DUPLICATES_CAP, cross_repo: bool = False) -> DataFrame:
    """Pairs of chunks of different files with a cosine of ``least`` or more, best first.

    ``corpus`` has repo, file_path, chunk_id and vector. Above ``cap`` chunks TooManyChunks is raised (None: no cap).
    Pairs of blocks that cannot reach ``least`` are skipped (``blocks``); the others are one matrix product each, of which the pairs that
    qualify come out, or the best ``limit``, as no more of them can be in the result.
    """
    rows = corpus.select("repo", "file_path", F.col("chunk_id").cast("long").alias("chunk_id"), F.col("vector").cast("array<double>").alias("vector"))
    n = rows.count()
    if cap is not None and n > cap:
        raise TooManyChunks(f"{n} chunks; pairs are compared up to {cap}")
    keys = ["repo", "file_path", "chunk_id"]
    points = B.pivots(rows, min(B.PIVOTS, n // B.BLOCK + 1))
    own = B.pack(rows, keys, points, _width(rows))
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{s}_{k} {kinds[c]}" for s in "ab" for k, c in (("repo", "repo"), ("file", "file_path"), ("chunk", "chunk_id"))) + ", similarity double"
    homes, guests = block_pairs(own, least)
    shown = np.empty(0)  # the best rounded similarities that a task has given; a pair below the last of ``limit`` cannot be among the best

    def work(home: dict, guest: dict) -> pa.RecordBatch | None:
        nonlocal shown
        same = home["number"] == guest["number"]
        sim = home["x"] @ guest["x"].T
        floor = least - 1e-12 if limit is None or len(shown) < limit else max(least - 1e-12, shown[-1] - 1e-6) if limit else np.inf
        near = sim >= floor
        if not near.any():
            return None
        columns = [pa.concat_arrays([h, g]) for h, g in zip(home["keys"], guest["keys"], strict=True)]
        m, total = len(home["x"]), len(home["x"]) if same else len(home["x"]) + len(guest["x"])
        # places by (repo, file, chunk), nulls first: ties go by them, and the smaller one comes first
        names = [[(v is not None, v) for v in c.to_pylist()] for c in columns]
        place = np.empty(m + len(guest["x"]), np.int64)
        place[sorted(range(total), key=list(zip(*names, strict=True)).__getitem__)] = np.arange(total)
        if same:
            place[m:] = place[:m]
        codes = [np.unique([str(x) for x in n], return_inverse=True)[1] for n in names[:2]]
        both = codes[0] * (1 << 32) + codes[1]
        p, q = np.nonzero(np.triu(near, 1) if same else near)
        hit = both[p] != both[m + q if not same else q]
        if cross_repo:
            hit &= codes[0][p] != codes[0][m + q if not same else q]
        p, q = p[hit], q[hit]
        score = sim[p, q]
        swap = place[p] > place[m + q]
        p, q = np.where(swap, m + q, p), np.where(swap, p, m + q)
        if limit is not None and len(score) > limit:
            said = np.round(score, 6)
            edge = np.partition(said, len(said) - limit)[len(said) - limit] if limit else np.inf
            some = np.flatnonzero(said >= edge)
            some = some[np.lexsort((place[q[some]], place[p[some]], -said[some]))[:limit]]
            p, q, score = p[some], q[some], score[some]
        if limit is not None:
            shown = -np.sort(-np.concatenate([shown, np.round(score, 6)]))[:limit]
        return pa.RecordBatch.from_arrays([*(c.take(pa.array(p)) for c in columns), *(c.take(pa.array(q)) for c in columns), pa.array(score)], [f"{s}_{k}" for s in "ab" for k in ("repo", "file", "chunk")] + ["similarity"])

    out = B.meet(own, own, homes, guests, work, schema).withColumn("similarity", F.round("similarity", 6))
    out = out.orderBy(F.desc("similarity"), "a_repo", "a_file", "a_chunk", "b_repo", "b_file", "b_chunk")
    return out.limit(limit) if limit is not None else out


def block_pairs(own: B.Blocks, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(home, guest) numbers of the pairs of blocks that have to meet, each once; groups of homes take turns, so that none has most guests."""
    near = np.triu(B.reach(own, own, least))
    i, j = np.nonzero(near)
    group = B.grouped(own.numbers)
    turn = (group[i] + group[j]) % 2 == 1
    return own.numbers[np.where(turn, j, i)], own.numbers[np.where(turn, i, j)]


def best_of_queries(corpus: DataFrame, queries: list[list[float]], vector: str = "vector") -> DataFrame:
    """``corpus`` with score, its highest cosine to any of the queries, at least 0; the vector goes.

    Without queries all scores are 0, as are those of vectors that are null, zero, not finite or of another width.
    """
    if not queries:
        return corpus.drop(vector).withColumn("score", F.lit(0.0))
    q = np.array(queries, np.float64).reshape(len(queries), -1)
    q = q / np.maximum(np.sqrt((q * q).sum(1, keepdims=True)), 1e-300)
    source = corpus.select(*[c for c in corpus.columns if c != vector], F.col(vector).cast("array<double>").alias("__v"))
    schema = source.drop("__v").schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _ = unit_rows(batch.column(batch.num_columns - 1), q.shape[1])
            best = np.maximum((x @ q.T).max(1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(best)], [*batch.schema.names[:-1], "score"])

    return source.mapInArrow(run, schema).withColumn("score", F.round("score", 6))


def neighbours(corpus: DataFrame, queries: list[list[float]], exclude: Column | None = None, top_k: int | None = RELATED_TOP_K, least: float = RELATED_MIN) -> DataFrame:
    """The best chunk of each file; files of score 0 stay unless ``least`` is above it."""
    rows = corpus if exclude is None else corpus.where(~exclude)
    scored = best_of_queries(rows, queries)
    first = Window.partitionBy("file_path").orderBy(F.desc("score"), "chunk_id")
    best = scored.withColumn("__n", F.row_number().over(first)).where((F.col("__n") == 1) & (F.col("score") >= least)).drop("__n")
    best = best.orderBy(F.desc("score"), "file_path", "chunk_id")
    return best.limit(top_k) if top_k is not None else best


def seeds(corpus: DataFrame, most: int = FLOOR_MAX_SEEDS) -> DataFrame:
    """The upper median chunk of every stride-th file in path order."""
    inner = Window.partitionBy("file_path")
    median = corpus.withColumns({"__n": F.count("*").over(inner), "__k": F.row_number().over(inner.orderBy("chunk_id")) - 1})
    median = median.where(F.col("__k") == F.floor(F.col("__n") / 2)).drop("__n", "__k")
    ranked = placed(median, ["file_path"], "__r")
    stride = max(1, -(-ranked.count() // most))
    return ranked.where(F.col("__r") % stride == 0).drop("__r")


def scores(corpus: DataFrame, edits: DataFrame, least: float = 0.0, top: int | None = None) -> DataFrame:
    """(edit, file_path, score): each edit's best cosine to a chunk of every other file, from ``least`` up.

    ``edits`` has edit, own (its file) and vector, in one row or several. Both sides are blocks; blocks of edits visit
    those of the corpus that can reach ``least``, in one plan whatever their number. Of each pair of blocks come the maxima by edit and file, or with ``top`` the
    best so many of each edit, as a file that is among the best overall is so where its maximum stands; maxima of pairs are aggregated in each task, then across.
    """
    kind = dict(corpus.dtypes)["file_path"]
    rows = corpus.select("file_path", F.col("vector").cast("array<double>").alias("vector"))
    asked = edits.select(F.col("edit").cast("long").alias("edit"), F.col("own").cast("string").alias("own"), F.col("vector").cast("array<double>").alias("vector"))
    schema = f"edit long, file_path {kind}, score double"
    width = asked.agg(F.max(F.size("vector"))).first()[0]
    if not width or width < 1:
        return corpus.sparkSession.createDataFrame([], schema)
    points = B.pivots(rows.where(F.size("vector") == width), min(B.PIVOTS, rows.count() // B.BLOCK + 1) if least > 0 else 0)
    rows = rows.select(F.col("file_path").cast("string").alias("name"), "file_path", "vector")
    home, guest = B.pack(rows, ["name", "file_path"], points, width, every=True), B.pack(asked, ["edit", "own"], points, width)
    at, by = np.nonzero(B.reach(home, guest, least) if least > 0 else np.ones((len(home.numbers), len(guest.numbers)), bool))

    def work(home: dict, guest: dict) -> pa.RecordBatch:
        names, of = np.unique(np.array(home["keys"][0].to_pylist(), object).astype(str), return_inverse=True)
        first = np.empty(len(names), np.int64)
        first[of[::-1]] = np.arange(len(of))[::-1]
        ids, group = np.unique(guest["keys"][0].to_numpy(), return_inverse=True)
        order = np.argsort(of, kind="stable")
        sim = np.maximum.reduceat((home["x"] @ guest["x"].T)[order], np.flatnonzero(np.diff(of[order], prepend=-1)), axis=0)
        sim[names[:, None] == np.array(guest["keys"][1].to_pylist(), object).astype(str)[None, :]] = -np.inf
        order = np.argsort(group, kind="stable")
        best = np.maximum.reduceat(sim[:, order], np.flatnonzero(np.diff(group[order], prepend=-1)), axis=1)
        own = np.isneginf(best)
        best = np.where(own, best, np.maximum(best, 0.0))
        if top is not None and len(names) > top:
            # files stand in order, so a stable sort leaves ties to the first by name
            rank = np.argsort(np.argsort(-np.round(best, 6), axis=0, kind="stable"), axis=0, kind="stable")
            best[rank >= top] = -np.inf
        f, e = np.nonzero(best >= max(least, 0.0) - 1e-6)
        return pa.RecordBatch.from_arrays([pa.array(ids[e]), home["keys"][1].take(pa.array(first[f])), pa.array(best[f, e])], ["edit", "file_path", "score"])

    out = B.meet(home, guest, home.numbers[at], guest.numbers[by], work, schema)
    return out.groupBy("edit", "file_path").agg(F.round(F.max("score"), 6).alias("score")).where(F.col("score") >= least)


def _blocks(rows, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(edits, their files as text, unit vectors) of usable rows, some at a time; one width for all."""
    held: list = []
    width = None

    def out():
        ids, own, x = zip(*held, strict=True)
        return np.array(ids, np.int64), np.array([str(f) for f in own]), np.stack(x)

    for r in rows:
        v = np.array(r.vector, np.float64) if r.vector and None not in r.vector else None
        n = np.sqrt((v * v).sum()) if v is not None else 0.0
        width = width or (len(v) if v is not None else None)
        if v is not None and len(v) == width and np.isfinite(n) and n > 0:
            held.append((r.edit, r.own, v / n))
        if len(held) == size:
            yield out()
            held = []
    if held:
        yield out()


def _seed_rows(corpus: DataFrame, most: int) -> Iterator[list]:
    """The usable seeds with unit vectors, at most ``most``."""
    rows = seeds(corpus, most).select(F.lit(0).alias("edit"), F.col("file_path").alias("own"), F.col("vector").cast("array<double>").alias("vector")).collect()
    for r in rows:
        for _, _, x in _blocks([r], 1):
            yield [(r, x[0])]


def best_neighbours(corpus: DataFrame, most: int = FLOOR_MAX_SEEDS) -> DataFrame:
    """(file_path, best): each seed's highest cosine to a chunk of another file. At most ``most`` seeds, those with a usable vector."""
    schema = f"file_path {dict(corpus.dtypes)['file_path']}, best double"
    own = [(r.own, v) for part in _seed_rows(corpus, most) for r, v in part]
    if not own:
        return corpus.sparkSession.createDataFrame([], schema)
    q = np.stack([v for _, v in own])
    files = [f for f, _ in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full(len(q), -np.inf)
        at = {f: k for k, f in enumerate(files)}
        for batch in batches:
            x, _ = unit_rows(batch.column(1), q.shape[1])
            sim = x @ q.T
            for r, f in enumerate(batch.column(0).to_pylist()):
                if f in at:
                    sim[r, at[f]] = -np.inf
            if len(sim):
                best = np.maximum(best, sim.max(0))
        keep = np.flatnonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(keep), pa.array(np.maximum(best[keep], 0.0))], ["k", "best"])

    parts = corpus.select("file_path", F.col("vector").cast("array<double>")).mapInArrow(run, "k long, best double").groupBy("k").agg(F.round(F.max("best"), 6).alias("best"))
    names = corpus.sparkSession.createDataFrame(list(enumerate(files)), f"k long, file_path {dict(corpus.dtypes)['file_path']}")
    return parts.join(F.broadcast(names), "k").select("file_path", "best")


def corpus_floor(corpus: DataFrame, percentile: int = FLOOR_PERCENTILE) -> float | None:
    """The percentile of the seeds' best scores; None for too many chunks or too few files."""
    n, files = corpus.agg(F.count("*"), F.countDistinct("file_path")).first()
    if n > FLOOR_MAX_CHUNKS or files < FLOOR_MIN_FILES:
        return None
    row = nearest_rank(best_neighbours(corpus), "best", [percentile]).first()
    return row.value if row else None


def resolve_floor(configured: float, stored: float | None, default: float = RELATED_MIN) -> float:
    """the stored floor replaces the default setting and can only raise any other."""
    if stored is None:
        return configured
    return stored if abs(configured - default) < 1e-6 else max(configured, stored)
