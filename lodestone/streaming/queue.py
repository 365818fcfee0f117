"""The edit queue: lines of epoch milliseconds, path and session; debounce with a cap, drain, attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Milliseconds of quiet that an edit waits for, and the longest it waits.
DEBOUNCE, MAX_WAIT = 10_000, 60_000


def parse(lines: DataFrame, column: str = "value", keep: list[str] | None = None) -> DataFrame:
    """(ts, path, session) of well-formed lines, and the columns ``keep``; others are skipped. Works on streams."""
    p = F.split(column, "\t")
    ok = F.size(p).between(2, 3) & F.rlike(p[0], F.lit(r"^\d{1,18}$")) & (p[1] != "")
    return lines.where(ok).select(p[0].cast("long").alias("ts"), p[1].alias("path"), F.nullif(F.get(p, F.lit(2)), F.lit("")).alias("session"), *(keep or []))


def format_line(ts, path, session):
    """A line for the queue."""
    return F.when(session.isNull(), F.concat_ws("\t", ts.cast("string"), path)).otherwise(F.concat_ws("\t", ts.cast("string"), path, session))


def collapse(queue: DataFrame) -> DataFrame:
    """A path's first and last edit."""
    return queue.groupBy("path").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("edits"))


def deadlines(queue: DataFrame, debounce: int = DEBOUNCE, max_wait: int = MAX_WAIT) -> DataFrame:
    """When each path falls due."""
    return collapse(queue).withColumn("deadline", F.least(F.col("last_seen") + debounce, F.col("first_seen") + max_wait))


def due(queue: DataFrame, now: int, debounce: int = DEBOUNCE, max_wait: int = MAX_WAIT) -> DataFrame:
    """Paths that are due."""
    return deadlines(queue, debounce, max_wait).where(F.col("deadline") <= now)


def next_deadline(queue: DataFrame, now: int, debounce: int = DEBOUNCE, max_wait: int = MAX_WAIT) -> DataFrame:
    """One row: the nearest deadline of what is not due."""
    return deadlines(queue, debounce, max_wait).where(F.col("deadline") > now).agg(F.min("deadline").alias("deadline"))


def latest_session(queue: DataFrame, order: str = "seq") -> DataFrame:
    """The session of a path's newest edit, null if that has none; ties go to the later line."""
    newest = F.max_by(F.struct("session"), F.struct("ts", order))
    return queue.groupBy("path").agg(newest.alias("n")).select("path", F.col("n.session").alias("session"))


def drained(queue: DataFrame, done: DataFrame) -> DataFrame:
    """R2: lines that survive a drain of (path, last_seen): newer ones, and other paths'."""
    out = queue.join(done.select("path", F.col("last_seen").alias("__upto")), "path", "left")
    return out.where(F.col("__upto").isNull() | (F.col("ts") > F.col("__upto"))).select(*queue.columns)


def distinct_paths(edits: DataFrame) -> DataFrame:
    """Edited paths once each, in order of their first edit."""
    return edits.groupBy("path").agg(F.min("seq").alias("seq")).orderBy("seq")
