"""Structured Streaming operators with state: debounce with a cap, what a session has seen or read, windows of a watcher.

State is of the second kind (``transformWithStateInPandas``): values and maps by key in RocksDB, with timers and time to
live. What a batch does not touch stays in the store and never goes through Python. A key's rows of one batch are taken
in their order, so a trigger bounds how many there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from lodestone.streaming.queue import DEBOUNCE, MAX_WAIT

#: Days after which a session's state goes, lines of one read, and milliseconds of a watcher's window.
TTL_DAYS, READ_LINES, WATCH = 7, 2000, 250

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def on_rocksdb(spark: SparkSession) -> None:
    """Let queries that this session starts keep state in RocksDB, unless the session names a store of its own."""
    if not spark.conf.get(PROVIDER).endswith(("RocksDBStateStoreProvider",)):
        spark.conf.set(PROVIDER, ROCKSDB)


def _millis(frame: pd.DataFrame, column: str = "ts") -> list[int]:
    return (frame[column].astype("int64") // {"ns": 1_000_000, "us": 1_000, "ms": 1}[frame[column].dt.unit]).tolist()


class _Debounce(StatefulProcessor):
    """A path's open round: when it began, its last edit, how many, and the timer at which it falls due."""

    def __init__(self, debounce: int, max_wait: int, by_event: bool):
        self.debounce, self.max_wait, self.by_event = debounce, max_wait, by_event

    def init(self, handle) -> None:
        self.handle = handle
        self.round = handle.getValueState("round", "first long, last long, n long, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.round.get()) if self.round.exists() else None
        out, timer = [], held.pop() if held else None
        for t in sorted(t for frame in rows for t in _millis(frame)):
            if held is not None and t >= self.due(held):
                out.append(held)
                held = None
            held = [t, t, 1] if held is None else [min(held[0], t), max(held[1], t), held[2] + 1]
        if timer is not None:
            self.handle.deleteTimer(timer)
        if self.by_event:
            timer = max(self.due(held), timerValues.getCurrentWatermarkInMs() + 1)
        else:
            timer = timerValues.getCurrentProcessingTimeInMs() + max(1, self.due(held) - held[1])
        self.handle.registerTimer(timer)
        self.round.update((*held, timer))
        if out:
            yield self.frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.round.exists():
            *held, timer = self.round.get()
            if timer == expiredTimerInfo.getExpiryTimeInMs():
                self.round.clear()
                yield self.frame(key, [held])

    def due(self, held: list) -> int:
        return min(held[1] + self.debounce, held[0] + self.max_wait)

    @staticmethod
    def frame(key, rounds: list) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *h) for h in rounds], columns=["path", "first_seen", "last_seen", "edits"])

    def close(self) -> None:
        pass


def debounced(edits: DataFrame, debounce: int = DEBOUNCE, max_wait: int = MAX_WAIT, clock: str = "event") -> DataFrame:
    """(path, first_seen, last_seen, edits) when a path falls due.

    ``edits`` streams (path string, ts timestamp). A path is due when its quiet time has passed or the cap since
    its first edit has, whichever is sooner: a value for each path that waits, and a timer. Edits of a micro-batch are taken
    in order, so one batch can hold several rounds of a path. By the event clock time is that of the edits, and an edit that comes later than the cap
    behind the newest one is dropped by the watermark (``late_rows`` counts them). By the processing clock
    ("processing") timers run in real time and no edit is ever dropped.
    """
    if clock not in ("event", "processing"):
        raise ValueError(f"no such clock: {clock}")
    by_event = clock == "event"
    on_rocksdb(edits.sparkSession)
    rows = (edits.withWatermark("ts", f"{max_wait} milliseconds") if by_event else edits).select("path", "ts")
    mode = "EventTime" if by_event else "ProcessingTime"
    return rows.groupBy("path").transformWithStateInPandas(_Debounce(debounce, max_wait, by_event), "path string, first_seen long, last_seen long, edits long", "append", mode)


def late_rows(query) -> int:
    """How many rows a running or ended query has dropped for being later than its watermark, in the progress it still keeps."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for op in p["stateOperators"])


class _Ranges(StatefulProcessor):
    """Ranges of lines by what they belong to; of those inside one another the outer one is kept.

    The state of a session is a map from its own keys (such as file and name) to the starts and ends of their ranges: a batch reads and writes
    the entries it touches.
    """

    def __init__(self, own: list[str], ttl_days: float | None):
        self.own, self.ttl = own, None if ttl_days is None else max(1, int(ttl_days * 86_400_000))

    def init(self, handle) -> None:
        self.ranges = handle.getMapState("ranges", ", ".join(f"{c} string" for c in self.own), "s array<long>, e array<long>", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        frame = frames[0] if len(frames) == 1 else pd.concat(frames)
        order = np.argsort(frame["seq"].to_numpy(), kind="stable")
        columns = [frame[c].to_numpy()[order].tolist() for c in ("start", "line_start", "line_end", *self.own)]
        stored = self.ranges.exists()  # a session without state has nothing to ask for
        held: dict[tuple, list] = {}
        touched, out = set(), []
        for start, s, e, *own in zip(*columns, strict=True):
            if start:
                if stored:
                    self.ranges.clear()
                stored, held, touched = False, {}, set()
            if s is None or e is None or s != s or e != e:
                continue
            own = tuple(x if x == x else None for x in own)
            at = tuple(x or "" for x in own)
            if at not in held:
                held[at] = list(zip(*self.ranges.getValue(at), strict=True)) if stored and self.ranges.containsKey(at) else []
            if not any(a <= s and b >= e for a, b in held[at]):
                held[at] = [(a, b) for a, b in held[at] if not (s <= a and e >= b)] + [(int(s), int(e))]
                touched.add(at)
                out.append((key[0], *own, int(s), int(e)))
        for at in touched:
            self.ranges.updateValue(at, tuple(list(x) for x in zip(*held[at], strict=True)))
        if out:
            yield pd.DataFrame(out, columns=["session", *self.own, "line_start", "line_end"])

    def close(self) -> None:
        pass


def _by_session(rows: DataFrame, own: list[str], ttl_days: float | None) -> DataFrame:
    on_rocksdb(rows.sparkSession)
    more = {"seq": F.lit(0).cast("long"), "start": F.lit(False)}
    rows = rows.withColumns({c: e for c, e in more.items() if c not in rows.columns})
    rows = rows.select("session", F.col("seq").cast("long"), F.coalesce("start", F.lit(False)).alias("start"), *own, F.col("line_start").cast("long"), F.col("line_end").cast("long"))
    kind = dict(rows.dtypes)["session"]
    schema = f"session {kind}, " + ", ".join(f"{c} string" for c in own) + ", line_start long, line_end long"
    return rows.groupBy("session").transformWithStateInPandas(_Ranges(own, ttl_days), schema, "append", "None" if ttl_days is None else "ProcessingTime")


def suppressed(hints: DataFrame, ttl_days: float | None = TTL_DAYS) -> DataFrame:
    """Hints (session, file_path, name, line_start, line_end) that their session has not been shown.

    A hint is known if a shown range of the same file and name contains it; a null name is the empty one. ``seq``, where
    it is there, orders the rows of a batch. A row whose ``start`` is true begins its session anew, before its own hint, if it has one
    (lines that are null are none). What a session was shown of a file and name goes ``ttl_days`` after it last changed, in processing
    time; None keeps it, as a run over what is there needs, since time to live keeps such a query going.
    """
    return _by_session(hints, ["file_path", "name"], ttl_days)


def read_windows(reads: DataFrame, ttl_days: float | None = TTL_DAYS) -> DataFrame:
    """What a session newly covers: reads (session, file_path, offset, limit) whose lines no window that it has read contains.

    A read covers at most 2000 lines from its offset; a limit of 0 covers none. ``seq``, ``start`` and ``ttl_days`` as in ``suppressed``.
    """
    w = read_window(F.col("offset"), F.col("limit"))
    return _by_session(reads.withColumns({"line_start": w["line_start"], "line_end": w["line_end"]}), ["file_path"], ttl_days)


def read_window(offset, limit):
    """The lines that a read covers: at most 2000; a limit of 0 covers none."""
    n = F.least(F.coalesce(limit, F.lit(READ_LINES)), F.lit(READ_LINES))
    start = F.greatest(F.coalesce(offset, F.lit(1)), F.lit(1))
    return F.when(n > 0, F.struct(start.alias("line_start"), (start + n - 1).alias("line_end")))


#: Rows of closed windows that leave Python at once.
GIVEN = 10_000


class _Watch(StatefulProcessor):
    """The open window of a repository: its first event, its timer, and its paths in order with their counts."""

    def __init__(self, width: int, by_event: bool):
        self.width, self.by_event = width, by_event

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start long, timer long, paths long")
        self.paths = handle.getMapState("paths", "path string", "place long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # twelve bytes a row are held; what windows that close within the batch count never goes to the store
        codes: dict[str | None, int] = {}
        times, paths = [], []
        for frame in rows:
            times.append(np.array(_millis(frame), np.int64))
            paths.append(np.array([codes.setdefault(p if p == p else None, len(codes)) for p in frame["path"].tolist()], np.int32))
        names = sorted(codes, key=lambda p: (p is None, p or ""))
        rank = np.empty(len(names), np.int32)
        rank[[codes[p] for p in names]] = np.arange(len(names))
        ms, path = np.concatenate(times), rank[np.concatenate(paths)]
        order = np.lexsort((path, ms))
        ms, path = ms[order], path[order]
        stored = self.open.exists()
        start, timer, n = self.open.get() if stored else (None, None, 0)
        held = {p: v for (p,), v in self.paths.iterator()} if stored else {}
        was, touched, out, at = timer, set(), [], 0
        while at < len(ms):
            if start is not None and ms[at] >= start + self.width:
                out += self.listed(key, start, held)
                start = None
                if len(out) >= GIVEN:
                    yield self.frame(out)
                    out = []
            if start is None:
                if stored:
                    self.paths.clear()
                start, n, held, touched, stored = int(ms[at]), 0, {}, set(), False
                now = timerValues.getCurrentWatermarkInMs() if self.by_event else timerValues.getCurrentProcessingTimeInMs()
                timer = max(start + self.width, now + 1) if self.by_event else now + self.width
            end = int(np.searchsorted(ms, start + self.width))
            found, first, counts = np.unique(path[at:end], return_index=True, return_counts=True)
            for k in np.argsort(first):
                p = names[found[k]]
                place, count = held.get(p, (n, 0))
                n += count == 0
                held[p] = (place, count + int(counts[k]))
                touched.add(p)
            at = end
        for p in touched:
            self.paths.updateValue((p,), held[p])
        if timer != was:
            if was is not None:
                self.handle.deleteTimer(was)
            self.handle.registerTimer(timer)
        self.open.update((start, timer, n))
        if out:
            yield self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists() and self.open.get()[1] == expiredTimerInfo.getExpiryTimeInMs():
            start = self.open.get()[0]
            self.open.clear()
            held = {p: v for (p,), v in self.paths.iterator()}
            self.paths.clear()
            yield self.frame(self.listed(key, start, held))

    @staticmethod
    def listed(key, start: int, held: dict) -> list[tuple]:
        return [(key[0], start, place, path, n) for place, path, n in sorted(((place, path, n) for path, (place, n) in held.items()), key=lambda x: x[0])]

    @staticmethod
    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["repo", "start", "place", "path", "n"])

    def close(self) -> None:
        pass


def windows(edits: DataFrame, milliseconds: int = WATCH, late: str | None = None) -> DataFrame:
    """(repo, start, place, path, n): the distinct paths of windows that begin with their first event and are not extended.

    ``edits`` streams (repo, path, ts). Windows close by the processing clock, and nothing is late; with ``late`` (an interval) they close by the clock of
    the events, of which those further behind than that are dropped. Paths of a window are numbered in order from 0.
    """
    on_rocksdb(edits.sparkSession)
    rows = (edits if late is None else edits.withWatermark("ts", late)).select("repo", "path", "ts")
    return rows.groupBy("repo").transformWithStateInPandas(_Watch(milliseconds, late is not None), "repo string, start long, place long, path string, n long", "append", "ProcessingTime" if late is None else "EventTime")


def indexer(edits: DataFrame, reindex: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """A query that hands each batch's distinct paths to ``reindex``, which must be idempotent."""
    each = lambda df, k: reindex(df.select("path").distinct(), k)
    return edits.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "250 milliseconds"})).start()
