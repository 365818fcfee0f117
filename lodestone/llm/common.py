"""What the training-data operators share: tables, scratch space, words, digests and connected components."""

from __future__ import annotations

import ctypes
import gc
import json
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.scratch import text_batches

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(name: str) -> Column:
    """A column of ids as whole numbers; an id that is none (a text, in tables of other kinds) counts as null."""
    return F.col(f"`{name}`").try_cast("long").alias(name)


#: Narrow rows of a file, where a table of known size is written.
FILE_ROWS = 500_000


class Scratch:
    """Tables written to the cluster's shared checkpoint folder, to cut lineage.

    The folder is the session's ``spark.checkpoint.dir``. Only a local session (tests) may leave it unset; it gets a
    temporary one. Tables go when they are dropped, or at the end of the driver's JVM.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        text_batches(spark)
        sc = spark.sparkContext
        top = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
        if not top:
            if not re.match(r"local(\[|$)", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            top = tempfile.mkdtemp(prefix="lodestone-")
            sc.setCheckpointDir(top)
        self.top = top.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def put(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """Write ``df`` once and return what was written.

        ``rows``: at most so many narrow rows will come; few rows are written to few files.
        """
        path = f"{self.top}/lodestone-{uuid.uuid4().hex}"
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
        df.write.parquet(path)
        fs, p = self._fs(path)
        fs.deleteOnExit(p)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._lodestone_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df in tables:
            if path := getattr(df, "_lodestone_path", None):
                fs, p = self._fs(path)
                fs.delete(p, True)

    def free(self, *tables: DataFrame) -> None:
        """``drop``, and let executors delete the shuffle files of jobs that have ended.

        They go once the driver's JVM collects its own garbage, which it may not do for long.
        """
        self.drop(*tables)
        released(self.spark)


def released(spark: SparkSession) -> None:
    """Give back what the driver no longer uses, Python's memory and the JVM's: both keep it otherwise, and the next stage's comes on top."""
    gc.collect()
    trimmed()
    spark._jvm.System.gc()


def trimmed() -> None:
    """Give back to the system what this Python has freed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


#: What this worker keeps from one task to the next.
_KEPT: dict[tuple, object] = {}


def kept(make: Callable, *args):
    """``make(*args)``, which a worker keeps from one task to the next until it goes over to another operator."""
    if (make, *args) not in _KEPT:
        let_go()
        _KEPT[(make, *args)] = make(*args)
    return _KEPT[(make, *args)]


def let_go() -> None:
    """Drop what this worker keeps for another operator, and give back its memory; workers live on, and the next operator's comes on top."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()
    trimmed()


#: Rows of one or two numbers up to which a side of a join is broadcast; a larger one is shuffled.
SMALL_ROWS = 200_000


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """``df``, a written table of one or two numbers a row, to be broadcast if its row count allows it."""
    return F.broadcast(df) if df.count() <= most else df


def unused(name: str, columns: list[str]) -> str:
    """``name``, made longer until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def numbered(docs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``docs`` written once with a long column that tells every row from every other, also repeated ones.

    The numbers are read back from the written table, so that no later run of a task can change them.
    """
    return scratch.put(docs.withColumn(name, F.monotonically_increasing_id()))


def keyed(docs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``docs`` (doc_id, text, ...) with a long column that names a row by what it says.

    It is the row's doc_id where no other row has that; rows with a null or repeated doc_id get a number over 2 ** 62
    from a hash of doc_id and text, so that only rows alike in both share one.
    """
    own = whole("doc_id")
    twice = scratch.put(docs.select(own.alias("id")).where("id is not null").groupBy("id").count().where("count > 1").select("id"))
    other = F.xxhash64(own, F.col("text")).bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    if twice.isEmpty():
        return docs.withColumn(name, F.coalesce(own, other))
    there = unused("__twice", [*docs.columns, name])
    rows = docs.withColumn(name, own)
    rows = rows.join(small(twice).select(F.col("id").alias(name), F.lit(True).alias(there)), name, "left")
    key = F.when(F.col(name).isNull() | F.col(there).isNotNull(), other).otherwise(F.col(name))
    return rows.withColumn(name, key).select(*(F.col(f"`{c}`") for c in docs.columns), name)


# -- words ---------------------------------------------------------------------------------------

_LOWER = {c: c + 32 for c in range(65, 91)}
#: Bytes of ASCII letters (lower-cased) and digits and of all non-ASCII characters stay; the rest become spaces.
ALNUM = bytes(_LOWER.get(c, c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Only white space (space and \x09-\x0D) separates; A-Z are lower-cased.
SPACED = bytes(32 if c == 32 or 9 <= c <= 13 else _LOWER.get(c, c) for c in range(256))
#: A word after each text; UTF-8 has no such byte.
MARK = b"\xff"


def binary(column: pa.Array) -> pa.Array:
    """UTF-8 bytes of a string column, without a copy."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def slices(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to ``most`` or less, or that are one row."""
    start = total = 0
    end = 0
    for end, n in enumerate(sizes, 1):
        if total + n > most and end - 1 > start:
            yield start, end - 1
            start, total = end - 1, 0
        total += n
    if end > start:
        yield start, end


def word_blocks(column: pa.Array, kind: bytes, most: int = 1 << 19) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, end row, words) for blocks of rows with about ``most`` bytes; MARK follows each row's words.

    Null and empty texts have no words. A text longer than ``most`` is a block of its own.
    """
    texts = binary(column).to_pylist()
    for s, e in slices((len(t) + 64 if t else 64 for t in texts), most):
        yield s, e, (b" \xff ".join([t.translate(kind) if t else b"" for t in texts[s:e]]) + b" \xff").split()


# -- 64-bit mixing ---------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class WordHash(dict):
    """Word bytes to 64-bit hashes, cached; emptied at ``most`` words so that memory is bounded."""

    def __init__(self, most: int = 100_000):
        import xxhash

        self.h, self.most = xxhash.xxh3_64_intdigest, most

    def __missing__(self, word: bytes) -> int:
        v = self.h(word)
        if len(word) <= 24:
            self[word] = v
        return v

    def array(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        self[MARK] = 0
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` word hashes."""
    n = len(h) - width + 1
    out = mix(h[:n] + U64(width))
    for i in range(1, width):
        out = mix(out * U64(0x9E3779B97F4A7C15) + h[i : n + i])
    return out


# -- equal keys ------------------------------------------------------------------------------------


def _sorted_holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over one sorted range of (key, check, doc_id, pos, ...): each row of a key that several documents have.

    Added are low and low_pos, the key's first row, and kind: 0, or 1 for rows of a key that may go on beyond the
    range, which stay for now; 2 is a summary of such a key: its first row, and in ``low`` its last document.
    """

    def out(names, rows, low, low_pos, kind):
        n = len(rows[0])
        if kind == 0:  # keys are not needed any more
            rows = [np.zeros(n, np.int64), np.zeros(n, np.int32), *rows[2:]]
        columns = [*rows, np.broadcast_to(low, n), np.broadcast_to(low_pos, n), np.full(n, kind, np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [*names, "low", "low_pos", "kind"])

    def summary(names, key, first, last):
        row = [np.array([key[0]], np.int64), np.array([key[1]], np.int32), np.array([first[0]], np.int64), np.array([first[1]], np.int32)]
        return out(names, [*row, *(np.zeros(1, np.int32) for _ in names[4:])], np.int64(last), np.int32(0), 2)

    # the last key so far: its first row, its last document, its rows while one document has them all
    key = first = last = held = None
    leading, names = True, None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.schema.names
        rows = [c.to_numpy() for c in batch.columns]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        keys, checks, docs, pos = rows[:4]
        starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])]))
        ends = np.append(starts[1:], len(keys))
        low, low_pos, high = docs[starts].copy(), pos[starts].copy(), docs[ends - 1]
        if key is not None and held is None and (keys[0], checks[0]) == key:
            low[0], low_pos[0] = first
        elif key is not None and held is None and leading:  # the leading key ended with the last batch
            yield summary(names, key, first, last)
            leading = False
        match = low != high
        a = 0  # groups before this one are done
        if leading:
            yield out(names, [x[: ends[0]] for x in rows], low[0], low_pos[0], 1)
            if len(starts) > 1:
                yield summary(names, (keys[0], checks[0]), (low[0], low_pos[0]), high[0])
                leading = False
            a = 1
        if a < len(starts):
            kept = match[a:]
            pick = np.repeat(kept, ends[a:] - starts[a:])
            if pick.any():
                sizes = (ends[a:] - starts[a:])[kept]
                yield out(names, [x[starts[a] :][pick] for x in rows], np.repeat(low[a:][kept], sizes), np.repeat(low_pos[a:][kept], sizes), 0)
        key, first, last = (keys[-1], checks[-1]), (low[-1], low_pos[-1]), high[-1]
        held = None if leading or match[-1] else [x[starts[-1] :] for x in rows]
    if key is not None:
        if held is not None:
            yield out(names, held, first[0], first[1], 1)
        yield summary(names, key, first, last)


def first_holders(rows: DataFrame, scratch: Scratch, n: int) -> DataFrame:
    """Rows of keys that several documents have, without the key and with low and low_pos, the key's first row.

    ``rows`` is a written table of ``n`` rows (key long, check int, doc_id long, pos int, further ints); two rows are of
    one key if key and check agree. Rows are dealt out by ranges and sorted, so each has its equals beside it, and are
    exchanged once. A range may end within a key: a frequent one is spread over tasks, and what the sides of such a
    border say of it, two rows a range, is put together afterwards.
    """
    names = rows.columns
    order = names[:4]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    found = scratch.put(ranged.mapInArrow(_sorted_holders, f"{kinds}, low bigint, low_pos int, kind int"), n)
    path = found._lodestone_path
    border = found.where("kind = 2").groupBy("key", "check").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.max("low").alias("high"))
    border = border.where("first.doc_id < high").select("key", "check", F.col("first.doc_id").alias("low"), F.col("first.pos").alias("low_pos"))
    # at most two rows a range: a hash table in one constant, which Spark folds once, so that no row has to be exchanged
    at = border.collect()
    table = [{} for _ in range(max(1, len(at)))]
    for r in at:
        table[r.key % len(table)][f"{r.key} {r.check}"] = [r.low, r.low_pos]
    slots = F.from_json(F.lit(json.dumps(table)), "array<map<string,array<bigint>>>")
    slot = F.get(slots, F.pmod("key", F.lit(len(table))).cast("int"))
    first = F.try_element_at(slot, F.concat_ws(" ", F.col("key").cast("string"), F.col("check").cast("string")))
    found = found.where("kind < 2").withColumn("first", F.when(F.col("kind") == 1, first)).where("kind = 0 or first is not null")
    out = found.select(*names[2:], F.coalesce(F.col("first")[0], "low").alias("low"), F.coalesce(F.col("first")[1], "low_pos").cast("int").alias("low_pos"))
    out._lodestone_path = path
    return out


# -- connected components --------------------------------------------------------------------------


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges, each with the smallest node it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        low, high = np.minimum(rx, ry), np.maximum(rx, ry)
        if (low == high).all():
            return nodes, nodes[root]
        np.minimum.at(root, high, low)
        while not np.array_equal(up := root[root], root):
            root = up


def _local_forest(batches: Iterator[pa.RecordBatch], most: int = 500_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out():
        nodes, roots = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        keep = nodes != roots
        return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(roots[keep])], ["u", "v"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(x[0]) for x in held) > most:
            yield out()
            held = []
    if held:
        yield out()


def components(edges: DataFrame, scratch: Scratch, rows: int | None = None) -> DataFrame:
    """(node, component) for all nodes of ``edges``; a component is its smallest node.

    ``edges`` has two long columns, the ends of an undirected edge; at most ``rows`` if that is known. Each task first replaces its edges
    by a spanning forest. Then large-star and small-star steps alternate until nothing changes, a number
    of rounds that grows with the logarithm of the longest path. A hub's smallest neighbour is aggregated
    before its edges are dealt out and written, so that both sides of the join that uses it are plain
    exchanges, of which Spark splits the hub's. Nothing is collected.
    """
    a, b = edges.columns
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    )
    e = scratch.put(e.mapInArrow(_local_forest, "u long, v long").distinct(), rows)
    was = _digest(e)
    while n := was[0]:
        both = e.union(e.select("v", "u"))
        low = scratch.put(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), 2 * n)
        e2 = both.join(small(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e2 = scratch.put(e2.where("u <> v").distinct(), 2 * n)
        low2 = scratch.put(e2.groupBy("u").agg(F.min("v").alias("m")), 2 * n)
        least = e2.join(small(low2), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = least.union(low2.select("u", F.col("m").alias("v")))
        e3 = scratch.put(least.where("u <> v").distinct(), 4 * n)
        now = _digest(e3)
        scratch.drop(e, e2, low, low2)
        e = e3
        if now == was:
            break
        was = now
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _digest(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
