"""Related code for the session that made an edit: which events count, what is still new to it, and how it reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as X
from lodestone.operators import ranges

#: Tools that change files.
EDIT_TOOLS = ("Write", "Edit", "MultiEdit", "NotebookEdit")


def failed(response: Column) -> Column:
    """Whether a tool's JSON response says that the call failed."""
    field = lambda name: F.get_json_object(response, f"$.{name}")
    return F.coalesce(field("is_error") == "true", F.lit(False)) | F.coalesce(field("success") == "false", F.lit(False)) | F.coalesce(field("error") != "null", F.lit(False))


def changed(tool: Column, response: Column) -> Column:
    """Whether a call changed a file: not if it failed, nor if an Edit says that its patch is empty."""
    patch = F.get_json_object(response, "$.structuredPatch")
    empty = F.coalesce((tool == "Edit") & (F.regexp_replace(patch, r"\s", "") == "[]"), F.lit(False))
    return ~failed(response) & ~empty


def edit_events(events: DataFrame) -> DataFrame:
    """The events (session, tool, response, ...) after which something may have changed."""
    return events.where(F.col("tool").isin(*EDIT_TOOLS) & changed(F.col("tool"), F.col("response")))


def edited_paths(events: DataFrame) -> DataFrame:
    """(session, path) of the files that events name in file_path, notebook_path or files_modified, each once an event."""
    every = F.array_compact(F.concat(F.array("file_path", "notebook_path"), F.coalesce("files_modified", F.array().cast("array<string>"))))
    return events.select("session", F.explode(F.array_distinct(every)).alias("path")).where("path <> ''")


def enqueued(events: DataFrame, watchable: Column, now: Column) -> DataFrame:
    """Queue rows (ts, path, session) of watchable edited files; ``watchable`` is a condition on the path."""
    return edited_paths(edit_events(events)).where(watchable).select(now.alias("ts"), "path", "session")


def attributed(markers: DataFrame, events: DataFrame) -> DataFrame:
    """Markers (session, ...) whose session is that of an event; without a session on either side none."""
    return markers.where("session is not null").join(events.where("session is not null").select("session").distinct(), "session", "left_semi")


def fresh(neighbours: DataFrame, seen: DataFrame, read: DataFrame, files: DataFrame, top_k: int) -> DataFrame:
    """What of ``neighbours`` is shown: (session, edited_path, file_path, name, line_start, line_end, score, rank, is_doc).

    Not the edited file itself, nor files that are gone or outside, nor what the session has been shown (``seen``: session,
    file_path, name and lines) or has read (``read``: session, file_path and lines); of the rest the best ``top_k``.
    """
    rows = neighbours.where((F.col("file_path") != F.col("edited_path")) & ~X.escapes(F.col("file_path")))
    rows = rows.join(files.select("file_path"), "file_path", "left_semi")  # P17
    rows = rows.withColumn("__name", F.coalesce("name", F.lit("")))
    shown = seen.withColumn("__name", F.coalesce("name", F.lit("")))
    rows = ranges.unseen(rows, shown, ["session", "file_path", "__name"])
    rows = ranges.unseen(rows, read, ["session", "file_path"])
    order = Window.partitionBy("session", "edited_path").orderBy(F.desc("score"), "file_path", "line_start", "line_end")
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    return rows.select("session", "edited_path", "file_path", "name", "line_start", "line_end", "score", "rank", X.is_doc_file(F.col("file_path")).alias("is_doc"))


def location(path: Column, start: Column, end: Column, name: Column, score: Column, gap: str = "  ") -> Column:
    """F16: path:lines, the name in backquotes if there is one, and the score; two spaces after an edit, one after a read."""
    named = F.when(name.isNotNull(), F.concat(F.lit(" `"), name, F.lit("`"))).otherwise(F.lit(""))
    return F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), named, F.lit(gap + "("), F.format_string("%.2f", score), F.lit(")"))


def contexts(hints: DataFrame, gap: str = "  ") -> DataFrame:
    """F16: (session, edited_path, context): a line each for code and for documents, locations in order, an empty one left out."""
    line = location(F.col("file_path"), F.col("line_start"), F.col("line_end"), F.col("name"), F.col("score"), gap)
    rows = hints.withColumn("entry", F.struct("rank", line.alias("line")))
    own = lambda doc: F.transform(F.array_sort(F.collect_list(F.when(F.col("is_doc") == doc, F.col("entry")))), lambda x: x["line"])
    both = rows.groupBy("session", "edited_path").agg(own(False).alias("code"), own(True).alias("docs"))
    part = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(label + " "), F.array_join(c, "; ")))
    return both.select("session", "edited_path", F.concat_ws("\n", part("related code:", "code"), part("related docs:", "docs")).alias("context"))


def merged(responses: DataFrame) -> DataFrame:
    """(session, context): a session's contexts in order, one a line; a single one as it is."""
    parts = F.array_sort(F.collect_list(F.struct("ord", "context")))
    return responses.where("context is not null").groupBy("session").agg(F.array_join(F.transform(parts, lambda x: x["context"]), "\n").alias("context"))


def compact_json(*columns: Column | str) -> Column:
    """F64: a JSON object without null fields and without false ones (for booleans, pass them by ``true_only``)."""
    return F.to_json(F.struct(*columns))


def true_only(flag: Column) -> Column:
    """A flag that JSON leaves out unless it is true."""
    return F.when(flag, F.lit(True))
