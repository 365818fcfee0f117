"""The edit queue as a streaming source: a folder of logs, whose offsets are bytes.

A writer appends whole lines to a log of its own; nothing that was written changes. A batch is what lies between two offsets, cut
into byte ranges that tasks read by themselves; a line belongs to the range that it begins in. The last line of a log counts once it has ended.
"""

from __future__ import annotations

import fcntl
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes that one task reads at most, a line more or less, and rows of a batch that it gives out.
RANGE, ROWS = 8 << 20, 10_000
NAME = "lodestone_queue"


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def append(folder: str, lines: list[str], log: str = "queue.log") -> None:
    """Whole lines at the end of a log, in one write under its lock; a line with a break of its own is refused."""
    if any("\n" in x or "\r" in x for x in lines):
        raise ValueError("a line of the queue has no line break")
    os.makedirs(_local(folder), exist_ok=True)
    with open(f"{_local(folder)}/{log}", "ab") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        f.write("".join(f"{x}\n" for x in lines).encode())


def ended(path: str, start: int = 0) -> int:
    """The bytes of a log up to its last line break; what lies before ``start`` is known to end there."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        at = size
        while at > start:
            low = max(start, at - (1 << 16))
            f.seek(low)
            k = f.read(at - low).rfind(b"\n")
            if k >= 0:
                return low + k + 1
            at = low
    return start


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class Reader(DataSourceStreamReader):
    """Offsets are the read bytes of each log."""

    def __init__(self, folder: str, size: int):
        self.folder, self.size = _local(folder), size
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        names = sorted(n for n in os.listdir(self.folder) if not n.startswith((".", "_"))) if os.path.isdir(self.folder) else []
        self.known = {n: ended(f"{self.folder}/{n}", self.known.get(n, 0)) for n in names}
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for name, upto in sorted(end.items()):
            for at in range(start.get(name, 0), upto, self.size):
                out.append(Range(f"{self.folder}/{name}", at, min(at + self.size, upto)))
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        with open(partition.path, "rb") as f:
            f.seek(max(0, partition.start - 1))
            if partition.start:
                f.readline()  # the line that another range began
            held, at = [], f.tell()
            while at < partition.end and (line := f.readline()):
                at += len(line)
                held.append((line.rstrip(b"\r\n").decode(errors="replace"), at))
                if len(held) == ROWS:
                    yield self.batch(partition, held)
                    held = []
            if held:
                yield self.batch(partition, held)

    @staticmethod
    def batch(partition: Range, held: list) -> pa.RecordBatch:
        lines, ends = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), pa.array([os.path.basename(partition.path)] * len(held)), pa.array(ends, pa.int64())], ["value", "log", "upto"])

    def commit(self, end: dict) -> None:
        pass


class QueueSource(DataSource):
    """``spark.readStream.format("lodestone_queue").option("path", folder)``: value, log, and the byte at which the line ends."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "value string, log string, upto long"

    def streamReader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("rangeBytes", RANGE)))


def stream(spark: SparkSession, folder: str, range_bytes: int = RANGE) -> DataFrame:
    """The lines of a folder of logs as a stream; ``streaming.queue.parse`` reads their fields."""
    spark.dataSource.register(QueueSource)
    return spark.readStream.format(NAME).option("path", folder).option("rangeBytes", str(range_bytes)).load()
