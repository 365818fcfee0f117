"""Small text files beside an index: session ledgers, one-slot markers, progress and error logs."""

from __future__ import annotations

import json
import os
import re
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X

SEEN = "file_path string, name string, line_start long, line_end long"
READ = "file_path string, line_start long, line_end long"


def _kinds(schema: str) -> list[tuple[str, str]]:
    return [tuple(x.split()) for x in schema.split(", ")]


def parse_ledger(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Rows of tab-separated lines with exactly as many fields, whole numbers where there should be; others are skipped."""
    p, kinds = F.split(column, "\t", -1), _kinds(schema)
    ok = F.size(p) == len(kinds)
    for k, (_, kind) in enumerate(kinds):
        if kind == "long":
            ok = ok & F.rlike(F.get(p, F.lit(k)), F.lit(r"^\d{1,18}$"))
    value = lambda k, kind: F.get(p, F.lit(k)).cast(kind) if kind == "long" else F.nullif(F.get(p, F.lit(k)), F.lit(""))
    return lines.where(F.coalesce(ok, F.lit(False))).select(*(value(k, kind).alias(name) for k, (name, kind) in enumerate(kinds)))


def read_ledger(spark: SparkSession, path: str, schema: str = SEEN) -> DataFrame:
    """A session's ledger; none is empty."""
    if not os.path.exists(path):
        return spark.createDataFrame([], schema)
    return parse_ledger(spark.read.text(path), schema)


def ledger_lines(rows: DataFrame, schema: str = SEEN) -> DataFrame:
    """Lines to append; a row with a tab or newline in any value is never written."""
    columns = [F.coalesce(F.col(name).cast("string"), F.lit("")) for name, _ in _kinds(schema)]
    safe = F.lit(True)
    for c in columns:
        safe = safe & X.ledger_safe(c)
    return rows.where(safe).select(F.concat_ws("\t", *columns).alias("value"))


def append_ledger(rows: DataFrame, path: str, schema: str = SEEN) -> None:
    """Add a session's rows, one file an append; the folder is the ledger."""
    ledger_lines(rows, schema).write.mode("append").text(path)


def write_marker(path: str, value: dict) -> None:
    """One JSON value, put there whole and readable by its owner alone."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    aside = f"{path}.{uuid.uuid4().hex}"
    with os.fdopen(os.open(aside, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "w") as f:
        json.dump(value, f)
    os.replace(aside, path)


def read_marker(path: str, remove: bool = False) -> dict | None:
    """The marker, if there is a readable one; ``remove`` takes it, so that only one reader gets it."""
    if remove:
        taken = f"{path}.{uuid.uuid4().hex}"
        try:
            os.replace(path, taken)
        except FileNotFoundError:
            return None
        path = taken
    try:
        return json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return None
    finally:
        if remove:
            os.unlink(path)


def progress(log: str, pid: int) -> tuple[int, int | None]:
    """Files done and in all, after the log's last "total N pid P" line if P is ``pid``; else nothing is known."""
    lines = log.splitlines()
    at = max((k for k, line in enumerate(lines) if line.startswith("total ")), default=None)
    m = re.fullmatch(r"total\s+(\d+)\s+pid\s+(\d+)\s*", lines[at]) if at is not None else None
    if m is None or int(m[2]) != pid:
        return 0, None
    return sum(line.split()[:1] in (["indexed"], ["verified"], ["skipped"]) for line in lines[at + 1 :]), int(m[1])


def last_error_line(log: str) -> str | None:
    """the last line that starts with "error:"."""
    return next((line for line in reversed(log.splitlines()) if line.startswith("error:")), None)
