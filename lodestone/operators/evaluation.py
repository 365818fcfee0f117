"""Measuring retrieval: symbol precision, score distributions, pools, session replay, sweeps."""

from __future__ import annotations

import io
import keyword
import re
import tokenize

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as X
from lodestone.operators import chunking
from lodestone.operators.ranks import nearest_rank
from lodestone.scratch import written

SESSION, DEPTHS = 10, (1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144)


def spread(n: int, k: int) -> list[int]:
    """K evenly spaced places of n, and the median."""
    k = min(k, n)
    own = [i * (n - 1) // (k - 1) for i in range(k)] if k > 1 else []
    return sorted({*own, n // 2}) if n else []


def identifiers(chunks: DataFrame) -> DataFrame:
    """(file_path, chunk_id, symbol): the distinct evaluable identifiers of each chunk's text."""
    words = F.array_distinct(F.regexp_extract_all("content", F.lit("[A-Za-z0-9_]+"), F.lit(0)))
    return chunks.select("file_path", "chunk_id", F.explode(words).alias("symbol")).where(X.evaluable(F.col("symbol")))


def mentions(chunks: DataFrame) -> DataFrame:
    """(symbol, mentions, files): in how many chunks and files other than its first an identifier stands.

    Chunks are counted by symbol and file before anything is exchanged by symbol, so a frequent word is a row a file.
    """
    per = identifiers(chunks).groupBy("symbol", "file_path").agg(F.count("*").alias("n"))
    every = per.groupBy("symbol").agg(F.min_by("n", "file_path").alias("home"), F.sum("n").alias("n"), F.count("*").alias("files"))
    return every.where("files > 1").select("symbol", (F.col("n") - F.col("home")).alias("mentions"), (F.col("files") - 1).alias("files"))


def pool(pairs: DataFrame, least: float = 0.0) -> DataFrame:
    """(edit, file_path, score, rank): each edit's files by their best score, from ``least`` up."""
    best = pairs.groupBy("edit", "file_path").agg(F.max("score").alias("score")).where(F.col("score") >= least)
    order = Window.partitionBy("edit").orderBy(F.desc("score"), "file_path")
    return best.withColumn("rank", F.row_number().over(order))


def pool_stats(pools: DataFrame, cap: int) -> DataFrame:
    """The largest pool, the 90th percentile, the mean, and how many pools pass the cap."""
    sizes = pools.groupBy("edit").agg(F.count("*").alias("n"))
    p90 = nearest_rank(sizes, "n", [90]).select(F.col("value").alias("p90"))
    out = sizes.agg(F.max("n").alias("largest"), F.round(F.avg("n"), 6).alias("mean"), F.count_if(F.col("n") > cap).alias("over_cap"))
    return out.crossJoin(F.broadcast(p90))  # one row each


def precision(hits: DataFrame, k: int) -> DataFrame:
    """Mean precision at k and at 1, base rate and lift of (edit, rank, relevant, base)."""
    per = hits.where(F.col("rank") <= k).groupBy("edit").agg(F.avg(F.col("relevant").cast("double")).alias("p"), F.max(F.when(F.col("rank") == 1, F.col("relevant").cast("double"))).alias("p1"), F.max("base").alias("base"))
    out = per.agg(F.avg("p").alias("p_at_k"), F.avg("p1").alias("p_at_1"), F.avg("base").alias("base"))
    lift = F.when(F.col("base") > 0, F.col("p_at_k") / F.col("base")).otherwise(F.lit(0.0))
    return out.select(F.round("p_at_k", 6).alias("p_at_k"), F.round("p_at_1", 6).alias("p_at_1"), F.round("base", 6).alias("base"), F.round(lift, 6).alias("lift"))


def edits(corpus: DataFrame, how: str | int = "median") -> DataFrame:
    """(edit, own, vector) rows, an edit for each file: its median chunk, "whole", or k spread chunks.

    ``corpus`` has file_path, chunk_id and vector. Edits are numbered by a hash of the path, so that neighbours in a
    session are no neighbours in the tree.
    """
    files = corpus.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "vector"))).alias("c"))
    n = F.size("c")
    if how == "whole":
        at = F.sequence(F.lit(0), n - 1)
    elif how == "median":
        at = F.array(F.floor(n / 2).cast("int"))
    else:
        k = F.least(F.lit(int(how)), n)
        even = F.when(k > 1, F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.floor(i * (n - 1) / (k - 1)).cast("int"))).otherwise(F.array().cast("array<int>"))
        at = F.array_distinct(F.concat(even, F.array(F.floor(n / 2).cast("int"))))
    picked = files.select("file_path", F.xxhash64(F.col("file_path").cast("string")).alias("edit"), F.explode(at).alias("k"), "c")
    return picked.select("edit", F.col("file_path").alias("own"), F.get("c", F.col("k"))["vector"].alias("vector"))


def _sessions(frame: pd.DataFrame, top_k: int, depth: int | None, dedup: bool) -> list[tuple]:
    """(edit, shown files, silent, repeated, starved) of a session's edits in order."""
    seen: set = set()
    lists: set = set()
    out = []
    for edit, own in frame.sort_values(["edit", "rank"]).groupby("edit", sort=True):
        every = list(own.file_path)
        near = every if depth is None else every[: top_k * depth]
        shown = [f for f in near if not (dedup and f in seen)][:top_k]
        starved = not shown and any(f not in seen for f in every[len(near) :])
        seen.update(shown)
        repeated = bool(shown) and tuple(shown) in lists
        lists.add(tuple(shown))
        out.append((int(edit), shown, not shown, repeated, starved))
    return out


def replay(pools: DataFrame, depth: int | None, top_k: int = 5, session: int = SESSION, dedup: bool = True) -> DataFrame:
    """(session, edit, file_path, repeated, starved): hints of sessions of consecutive edits, none shown twice in one.

    ``pools`` has edit (0, 1, ...), file_path, rank. An edit's hints are the first ``top_k`` of its ``top_k * depth``
    best files (None: of all) that its session has not shown; without ``dedup`` also those it has. A silent edit has a
    row without a file; starved, if there were new files beyond the depth. repeated: the session has had the same list.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        own = int(frame.session.iloc[0])
        rows = [(own, edit, f, repeated, starved) for edit, shown, _, repeated, starved in _sessions(frame, top_k, depth, dedup) for f in shown or [None]]
        return pd.DataFrame(rows, columns=["session", "edit", "file_path", "repeated", "starved"]).astype({"file_path": object})

    kind = dict(pools.dtypes)["file_path"]
    df = pools.withColumn("session", F.floor(F.col("edit") / session).cast("long")).select("session", "edit", "file_path", "rank")
    return df.groupBy("session").applyInPandas(run, f"session long, edit long, file_path {kind}, repeated boolean, starved boolean")


def replay_stats(hints: DataFrame, edits: int) -> DataFrame:
    """Emitted hints, silent edits, distinct files, repeated lists, starved edits, and the file shown most (ties: the last by name)."""
    shown = hints.where("file_path is not null")
    files = shown.groupBy("file_path").agg(F.count("*").alias("n"))
    hub = files.agg(F.max_by("file_path", F.struct("n", "file_path")).alias("hub"), F.count("*").alias("files"))
    one = hints.groupBy("edit").agg(F.count("file_path").alias("n"), F.bool_or("repeated").alias("repeated"), F.bool_or("starved").alias("starved"))
    out = one.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("emitted"),
        (F.lit(edits) - F.count_if(F.col("n") > 0)).alias("silent"),
        F.count_if("repeated").alias("repeated_lists"),
        F.count_if("starved").alias("starved"),
    )
    return out.crossJoin(F.broadcast(hub))  # one row each


def judged(chunks: DataFrame, pools: DataFrame, top_k: int = 5) -> DataFrame:
    """(edit, symbol, files, file_path, rank, score, there): the neighbours of each symbol's chunk, and whether they mention the symbol.

    ``chunks`` has file_path, chunk_id, name and content; ``pools`` (edit, file_path, score, rank) the neighbours of each chunk
    by its chunk_id, without a floor. Symbols that no other file mentions are left out; files: how many do.
    """
    symbols = chunks.where(X.evaluable(F.col("name"))).select(F.col("chunk_id").alias("edit"), F.col("file_path").alias("own"), F.col("name").alias("symbol"))
    where = identifiers(chunks).select("symbol", "file_path").distinct()
    targets = symbols.join(where, "symbol").where("file_path <> own").groupBy("edit", "symbol").agg(F.count("*").alias("files"))
    hits = pools.where(F.col("rank") <= top_k).join(targets, "edit")
    hits = hits.join(where.withColumn("there", F.lit(1)), ["symbol", "file_path"], "left")
    return hits.select("edit", "symbol", "files", "file_path", "rank", "score", F.coalesce("there", F.lit(0)).cast("double").alias("there"))


def symbol_precision(chunks: DataFrame, pools: DataFrame, top_k: int = 5, rare: int = 3) -> DataFrame:
    """How often neighbours of a symbol's chunk mention the symbol (``judged``), against chance; one row.

    rare: at most so many files mention the symbol.
    """
    n = chunks.select("file_path").distinct().count()
    per = judged(chunks, pools, top_k).groupBy("edit", "files").agg(F.avg("there").alias("p"), F.max(F.when(F.col("rank") == 1, F.col("there"))).alias("p1"))
    base = F.col("files") / F.lit(float(max(n - 1, 1)))
    few = F.col("files") <= rare
    lift = lambda p, b: F.round(F.when(b > 0, p / b).otherwise(F.lit(0.0)), 6)
    out = per.agg(F.count("*").alias("evaluated"), F.avg("p").alias("p"), F.avg("p1").alias("p1"), F.avg(base).alias("b"), F.count_if(few).alias("rare"), F.avg(F.when(few, F.col("p"))).alias("rp"), F.avg(F.when(few, base)).alias("rb"))
    return out.select("evaluated", F.round("p", 6).alias("p_at_k"), F.round("p1", 6).alias("p_at_1"), F.round("b", 6).alias("base"), lift(F.col("p"), F.col("b")).alias("lift"), "rare", F.round("rp", 6).alias("rare_p_at_k"), F.round("rb", 6).alias("rare_base"))


def _at(values: DataFrame, column: str, percents: list[int]) -> dict[int, float]:
    return {r.p: r.value for r in nearest_rank(values, column, percents).collect()}  # a row for each percentage


def score_report(pools: DataFrame, edits: DataFrame, top_k: int, floor: float) -> DataFrame:
    """One row: percentiles of each edit's best and ``top_k``-th score without a floor, and how many edits keep one hint, or all, at ``floor``.

    ``pools`` (edit, file_path, score, rank); an edit of ``edits`` (edit) without so many neighbours counts as 0.
    """
    own = pools.groupBy("edit").agg(F.max("score").alias("best"), F.max(F.when(F.col("rank") == top_k, F.col("score"))).alias("kth"))
    own = edits.select("edit").distinct().join(own, "edit", "left").select("edit", F.coalesce("best", F.lit(0.0)).alias("best"), F.coalesce("kth", F.lit(0.0)).alias("kth"))
    own = written(own, "scores")
    best, kth = _at(own, "best", [10, 25, 50, 75, 90, 100]), _at(own, "kth", [10, 50, 90, 100])
    out = own.agg(F.count("*").alias("edits"), F.count_if(F.col("best") >= floor).alias("some"), F.count_if(F.col("kth") >= floor).alias("every"))
    share = lambda c: F.round(F.when(F.col("edits") > 0, F.lit(100.0) * F.col(c) / F.col("edits")).otherwise(F.lit(0.0)), 6).alias(f"{c}_pct")
    said = [F.lit(v).cast("double").alias(f"{name}_p{p}") for name, table, at in (("best", best, [10, 25, 50, 75, 90, 100]), ("kth", kth, [10, 50, 90, 100])) for p in at for v in [table.get(p, 0.0)]]
    return out.select("edits", "some", share("some"), "every", share("every"), *said)


def floor_report(pools: DataFrame, hits: DataFrame, edits: DataFrame, percents: list[int], top_k: int) -> DataFrame:
    """(p, floor, clear, per_edit, cover, precision, precision_1) for floors at percentiles of the edits' best scores.

    clear: per cent of edits that keep a neighbour; per_edit: hints an edit, ``top_k`` at most; cover: per cent of judged symbols that keep a
    hit; precision of the hits that they keep, and of the first one. ``hits`` as from ``judged``. Each table is read once, whatever the number of floors.
    """
    best = edits.select("edit").distinct().join(pools.where("rank = 1").select("edit", "score"), "edit", "left").select(F.coalesce("score", F.lit(0.0)).alias("best"))
    floors = _at(best, "best", percents)
    n = edits.select("edit").distinct().count()
    own, of = pools.groupBy("edit"), hits.groupBy("edit", "symbol")
    over = lambda f: F.col("score") >= F.lit(floors[f])
    kept = own.agg(*(F.count_if(over(p) & (F.col("rank") <= top_k)).alias(f"k{p}") for p in floors))
    one = of.agg(*(x for p in floors for x in (F.avg(F.when(over(p), F.col("there"))).alias(f"p{p}"), F.max(F.when(over(p) & (F.col("rank") == 1), F.col("there"))).alias(f"f{p}"))))
    volume = kept.agg(*(x for p in floors for x in (F.count_if(F.col(f"k{p}") > 0).alias(f"c{p}"), F.sum(f"k{p}").alias(f"e{p}")))).first()
    quality = one.agg(F.count("*").alias("n"), *(x for p in floors for x in (F.count(f"p{p}").alias(f"n{p}"), F.avg(f"p{p}").alias(f"p{p}"), F.sum(f"f{p}").alias(f"f{p}")))).first()
    rows = [
        (p, float(v), 100.0 * volume[f"c{p}"] / max(n, 1), (volume[f"e{p}"] or 0) / max(n, 1), 100.0 * quality[f"n{p}"] / max(quality["n"], 1), quality[f"p{p}"] or 0.0, (quality[f"f{p}"] or 0.0) / max(quality[f"n{p}"], 1))
        for p, v in sorted(floors.items())
    ]
    out = pools.sparkSession.createDataFrame(rows, "p int, floor double, clear double, per_edit double, cover double, precision double, precision_1 double")
    return out.select("p", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


def code_identifiers(content: str, language: str) -> set[str] | None:
    """The identifiers of a text outside its comments and strings; None for a language without a chunker."""
    if language == "python":
        out = set()
        try:
            for t in tokenize.generate_tokens(io.StringIO(content).readline):
                if t.type == tokenize.NAME and not keyword.iskeyword(t.string):
                    out.add(t.string)
        except (tokenize.TokenError, SyntaxError, ValueError):
            pass  # what was read before the fault counts
        return out
    if language not in chunking.CHUNKERS:
        return None
    how = "sql" if language == "sql" else "tick" if language in ("typescript", "javascript", "go") else "c"
    return set(re.findall("[A-Za-z_][A-Za-z0-9_]*", chunking._masked(content.encode(), how).decode(errors="replace")))


def depth_sweep(pools: DataFrame, edits: int, depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """E5: replay statistics at several depths."""
    out = None
    for d in depths:
        one = replay_stats(replay(pools, d), edits).withColumn("depth", F.lit(d))
        out = one if out is None else out.union(one)
    return out
