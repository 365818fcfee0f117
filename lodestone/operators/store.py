"""The chunk table and its manifest: Parquet in hash buckets, and numbered state files, of which the last says what counts.

Chunks, file hashes and counts are kept by bucket, so a write reads and writes the buckets of its files and nothing else. It puts new folders
beside the old ones and then adds the next state file, which succeeds for one writer only; another one looks whether its own
buckets are as it found them, and goes on from the new state or does its work again. Whoever reads sees one state, never a mixture, and
its folders stay for a while after a later state has left them out (``vacuum``).
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.scratch import few, written

SCHEMA_VERSION = 1
CHUNKS = T.StructType(
    [
        T.StructField("repo", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("byte_start", T.LongType()),
        T.StructField("byte_end", T.LongType()),
        T.StructField("line_start", T.LongType()),
        T.StructField("line_end", T.LongType()),
        T.StructField("chunk_id", T.LongType()),
        T.StructField("language", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("file_hash", T.BinaryType()),
        T.StructField("content", T.StringType()),
        T.StructField("vector", T.ArrayType(T.FloatType())),
    ]
)
FILES = T.StructType([T.StructField("file_path", T.StringType()), T.StructField("file_hash", T.BinaryType())])


class IdentityError(ValueError):
    """The stored index belongs to another schema, model or width."""


class Conflict(RuntimeError):
    """Other writers came first too often."""


class SchemaMismatch(IdentityError):
    pass


class ModelMismatch(IdentityError):
    pass


class WidthMismatch(IdentityError):
    pass


@dataclass(frozen=True)
class Manifest:
    """What an index says of itself. The hashes of its files are a table beside it (``Store.files``)."""

    embedding_model: str
    dimensions: int
    schema_version: int = SCHEMA_VERSION
    last_full_index_at: str | None = None
    last_incremental_at: str | None = None
    chunk_count: int = 0
    file_count: int = 0
    similarity_floor: float | None = None
    #: The last batch of each stream that has gone in.
    batches: dict | None = None

    def check(self, model: str, dimensions: int) -> None:
        """Schema, then model, then width."""
        if self.schema_version != SCHEMA_VERSION:
            raise SchemaMismatch(f"schema {self.schema_version}, expected {SCHEMA_VERSION}")
        if self.embedding_model != model:
            raise ModelMismatch(f"model {self.embedding_model}, expected {model}")
        if self.dimensions != dimensions:
            raise WidthMismatch(f"width {self.dimensions}, expected {dimensions}")


def changed_files(current: DataFrame, stored: DataFrame, force: DataFrame | None = None) -> DataFrame:
    """Current files (file_path, file_hash) that are new, differ, or are to be checked again."""
    old = stored.select("file_path", F.col("file_hash").alias("__old"))
    out = current.join(old, "file_path", "left")
    again = F.lit(False)
    if force is not None:
        out = out.join(force.select("file_path", F.lit(True).alias("__force")), "file_path", "left")
        again = F.coalesce("__force", F.lit(False))
    out = out.where(F.col("__old").isNull() | (F.col("__old") != F.col("file_hash")) | again)
    return out.select(*current.columns)


def orphans(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Stored files that are no longer there."""
    return stored.join(current.select("file_path"), "file_path", "left_anti")


def stale(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Paths to delete: changed ones and orphans."""
    return changed_files(current, stored).select("file_path").union(orphans(stored, current).select("file_path"))


def preserved(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored paths that are still there and unchanged."""
    kept = stored.select("file_path").join(current.select("file_path"), "file_path", "left_semi")
    return kept.join(changed_files(current, stored).select("file_path"), "file_path", "left_anti")


def matches(current: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: how many paths differ, and whether none does and there are some."""
    a, b = current.select("file_path", F.col("file_hash").alias("a")), stored.select("file_path", F.col("file_hash").alias("b"))
    both = a.join(b, "file_path", "full_outer")
    return both.agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("differing"), F.count("*").alias("paths")).withColumn("in_sync", (F.col("differing") == 0) & (F.col("paths") > 0))


def delete_paths(table: DataFrame, paths: DataFrame) -> DataFrame:
    """S15."""
    return table.join(paths.select("file_path"), "file_path", "left_anti")


def upsert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows' files are replaced."""
    return delete_paths(table, rows.select("file_path").distinct()).unionByName(rows)


#: How often a write goes on from another one's state, and milliseconds for which readers of an old state keep its folders.
TRIES, KEEP_MS = 20, 3_600_000
#: Parquet settings of the chunks: a file that has not a path is told by its Bloom filter.
BLOOM = {"parquet.bloom.filter.enabled#file_path": "true", "parquet.bloom.filter.expected.ndv#file_path": "10000"}


class Store:
    """A table of chunks under ``root`` with its manifest and the hashes of the files it covers."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, schema: T.StructType = CHUNKS):
        self.spark, self.root, self.buckets, self.schema = spark, root.rstrip("/"), buckets, schema

    # -- the state files

    def _path(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _listed(self) -> list[tuple[str, int]]:
        """(name, when it was last written) of all that lies at the top."""
        fs, top = self._path("")
        return sorted((x.getPath().getName(), x.getModificationTime()) for x in fs.listStatus(top)) if fs.exists(top) else []

    @staticmethod
    def _is_state(name: str) -> bool:
        return name.startswith("state-") and name.endswith(".json")

    def _load(self, name: str) -> dict:
        fs, p = self._path(name)
        source = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def _state(self) -> dict:
        """version, manifest, and for each bucket the folders of its chunks and of its hashes and the counts of chunks and files."""
        last = max((n for n, _ in self._listed() if self._is_state(n)), default=None)
        return self._load(last) if last else {"version": 0, "manifest": None, "chunks": None, "files": None, "counts": {}}

    def _commit(self, build: Callable[[dict], dict]) -> dict:
        """``build`` gives the state after the present one. It is written aside and renamed to the next number, if that is still free; else ``build`` is asked again."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        for _ in range(TRIES):
            was = self._state()
            state = build(was) | {"version": was["version"] + 1}
            if state["manifest"] is not None and state["counts"] != was["counts"]:
                totals = [sum(c[k] for c in state["counts"].values()) for k in (0, 1)]
                state["manifest"] = state["manifest"] | {"chunk_count": totals[0], "file_count": totals[1]}
            fs, p = self._path(f"state-{state['version']:012d}.json")
            _, aside = self._path(f"aside-{uuid.uuid4().hex}")
            out = fs.create(aside, True)
            out.write(bytearray(json.dumps(state).encode()))
            out.close()
            try:
                none = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
                hadoop.FileContext.getFileContext(p.toUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, p, none)
                return state
            except Exception as e:
                fs.delete(aside, False)
                if "FileAlreadyExists" not in str(e):
                    raise
        raise Conflict(f"{TRIES} other writes came first")

    def vacuum(self, keep_ms: int = KEEP_MS) -> None:
        """Delete states that were superseded more than ``keep_ms`` ago, and what no other state names, unless a write may still be at it.

        A reader that took its rows within that time keeps its files; a bucket's folder goes by itself, whatever its neighbours do.
        """
        old = time.time() * 1000 - keep_ms
        listed = self._listed()
        states = [(n, t) for n, t in listed if self._is_state(n)]
        kept = [n for k, (n, _) in enumerate(states) if k + 1 == len(states) or states[k + 1][1] >= old]
        named = {d for n in kept for kind in ("chunks", "files") for dirs in (self._load(n)[kind] or {}).values() for d in dirs}
        for name, at in listed:
            fs, p = self._path(name)
            if self._is_state(name):
                if name not in kept:
                    fs.delete(p, False)
            elif name.startswith("aside-"):
                if at < old:
                    fs.delete(p, False)
            elif name.startswith(("data-", "files-")):
                inner = [x.getPath() for x in fs.listStatus(p) if x.isDirectory()]
                live = {x.getName() for x in inner if f"{name}/{x.getName()}" in named}
                if at < old:
                    for x in [x for x in inner if x.getName() not in live] if live else [p]:
                        fs.delete(x, True)

    # -- reading

    def exists(self) -> bool:
        return self._state()["chunks"] is not None

    def _read(self, state: dict, buckets: list[int] | None = None) -> DataFrame:
        dirs = [f"{self.root}/{d}" for b, own in sorted((state["chunks"] or {}).items()) if buckets is None or int(b) in buckets for d in own]
        if not dirs:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*dirs)

    def rows(self) -> DataFrame:
        """All rows; an absent index is an empty frame and nothing is created."""
        return self._read(self._state())

    def _bucket(self, path) -> F.Column:
        return F.pmod(F.xxhash64(path), F.lit(self.buckets)).cast("int")

    def _buckets_of(self, paths: DataFrame) -> list[int]:
        """Which buckets some paths are in: at most ``buckets`` numbers."""
        return [r.b for r in paths.select(self._bucket("file_path").alias("b")).distinct().collect()]

    def file(self, path: str) -> DataFrame:
        """One file's chunks, from its bucket alone."""
        bucket = self.spark.range(1).select(self._bucket(F.lit(path))).first()[0]
        return self._read(self._state(), [bucket]).where(F.col("file_path") == path).orderBy("byte_start", "chunk_id")

    def metadata(self) -> DataFrame:
        """Without content and vectors, which are then never read."""
        return self.rows().select("file_path", "file_hash", "language", "name")

    def paths(self) -> DataFrame:
        """S8."""
        return self.rows().select("file_path").distinct()

    def light(self) -> DataFrame:
        """All but the content."""
        return self.rows().drop("content")

    def count(self) -> int:
        """S10."""
        return self.rows().count()

    def manifest(self) -> Manifest | None:
        own = self._state()["manifest"]
        return None if own is None else Manifest(**own)

    def _hashes(self, state: dict, buckets: list[int] | None = None) -> DataFrame:
        claimed = (state["manifest"] or {}).get("chunk_count", 0)
        if state["files"] is None or (claimed and not state["chunks"]):
            return self._read(state, buckets).groupBy("file_path").agg(F.max("file_hash").alias("file_hash"))
        dirs = [f"{self.root}/{d}" for b, own in sorted(state["files"].items()) if buckets is None or int(b) in buckets for d in own]
        return self.spark.read.schema(FILES).parquet(*dirs) if dirs else self.spark.createDataFrame([], FILES)

    def files(self, paths: DataFrame | None = None) -> DataFrame:
        """(file_path, file_hash) of the files that the index covers, those without chunks too; of some ``paths`` from their buckets alone.

        Where the hashes are missing, or the table is empty though the manifest speaks of chunks, they come from the rows.
        """
        if paths is None:
            return self._hashes(self._state())
        return self._hashes(self._state(), self._buckets_of(paths)).join(paths.select("file_path").distinct(), "file_path", "left_semi")

    # -- writing

    def _write(self, rows: DataFrame, kind: str, options: dict) -> dict[str, list[str]]:
        """Rows in a new folder for each bucket; a large bucket is several files of a task each."""
        name = f"{kind}-{uuid.uuid4().hex}"
        own = rows.withColumn("bucket", self._bucket("file_path"))
        own.hint("rebalance", "bucket").write.options(**options).partitionBy("bucket").parquet(f"{self.root}/{name}")
        fs, top = self._path(name)
        found = [x.getPath().getName() for x in fs.listStatus(top) if x.isDirectory()]
        return {d.removeprefix("bucket="): [f"{name}/{d}"] for d in found}

    def _write_chunks(self, rows: DataFrame) -> dict[str, list[str]]:
        return self._write(rows.select(*self.schema.fieldNames()), "data", BLOOM)

    def _write_files(self, files: DataFrame) -> dict[str, list[str]]:
        return self._write(files.select("file_path", F.col("file_hash").cast("binary").alias("file_hash")), "files", {})

    def _counted(self, chunks: dict[str, list[str]], buckets) -> dict[str, list[int]]:
        """Chunks and files of some buckets as they have landed, from the paths alone."""
        found = {b: dirs for b, dirs in chunks.items() if int(b) in buckets}
        rows = self._read({"chunks": found}).groupBy(self._bucket("file_path").alias("b")).agg(F.count("*").alias("n"), F.countDistinct("file_path").alias("f")).collect() if found else []
        return {str(r.b): [r.n, r.f] for r in rows}

    def _checked(self, rows: DataFrame, width: int | None) -> DataFrame:
        from lodestone.functions.vectors import valid

        if width is None:
            return rows
        ok = F.assert_true(valid(F.col("vector"), width), F.lit(f"a vector is not {width} finite numbers"))
        return rows.where(ok.isNull())

    def append(self, rows: DataFrame, width: int | None = None) -> None:
        """Rows whose vectors are not ``width`` finite numbers stop the write, and nothing is added."""
        new = self._write_chunks(self._checked(rows, width))

        def build(was: dict) -> dict:
            chunks = dict(was["chunks"] or {})
            chunks |= {b: [*chunks.get(b, []), *dirs] for b, dirs in new.items()}
            return was | {"chunks": chunks, "counts": was["counts"] | self._counted(chunks, {int(b) for b in new})}

        self._commit(build)

    def _rewrite(self, touched: DataFrame, rows: DataFrame | None, files: DataFrame | None, **more) -> dict | None:
        """Replace the rows of some files, and their hashes by ``files`` (None: leave them out); ``more`` goes into the manifest.

        Only the buckets of these files are read and written. If another write changed one of them meanwhile the work is done again.
        """
        # written, as it is read for the buckets, for chunks and hashes, and again after another write; where paths are few no chunk is exchanged to find its own
        touched = written(touched.select("file_path").distinct(), "touched")
        buckets = self._buckets_of(touched)
        if not buckets:
            return None
        made: dict = {}
        touched = few(touched)

        def build(was: dict) -> dict:
            parts = {kind: {b: d for b, d in (was[kind] or {}).items() if int(b) in buckets} for kind in ("chunks", "files")}
            hashes = was["files"] is not None or files is not None
            if not made or made["from"] != (parts, hashes):
                kept = delete_paths(self._read(was, buckets), touched)
                chunks = self._write_chunks(kept if rows is None else kept.unionByName(rows.select(*self.schema.fieldNames())))
                made.update({"from": (parts, hashes), "chunks": chunks, "counts": self._counted(chunks, set(buckets))})
                if hashes:
                    left = delete_paths(self._hashes(was, buckets), touched)
                    made["files"] = self._write_files(left if files is None else left.unionByName(files.select("file_path", F.col("file_hash").cast("binary").alias("file_hash"))))
            rest = lambda kind: {b: x for b, x in (was[kind] or {}).items() if int(b) not in buckets}
            state = was | {"chunks": rest("chunks") | made["chunks"], "counts": rest("counts") | made["counts"]}
            if hashes:
                # hashes that were never kept come from the rows of the other buckets
                others = rest("files") if was["files"] is not None else self._write_files(delete_paths(self._hashes(was), touched)) if was["chunks"] else {}
                state["files"] = {b: d for b, d in others.items() if int(b) not in buckets} | made["files"]
            if more and state["manifest"] is not None:
                state["manifest"] = state["manifest"] | more
            return state

        return self._commit(build)

    def delete(self, paths: DataFrame) -> None:
        """files' chunks and hashes go, and the manifest's counts follow."""
        if self.exists():
            self._rewrite(paths, None, None)

    def replace(self, rows: DataFrame, width: int | None = None) -> None:
        """The rows' files are replaced; hashes of other files stay, also of those without chunks."""
        rows = self._checked(rows, width)
        hashes = rows.groupBy("file_path").agg(F.max("file_hash").alias("file_hash"))
        self._rewrite(rows, rows, hashes)

    def note(self, files: DataFrame) -> None:
        """Remember the hashes of files that gave no chunks; what the table had of them goes."""
        self._rewrite(files, None, files)

    def reset(self) -> None:
        """An empty table; the manifest stays."""
        self._commit(lambda was: was | {"chunks": {}, "files": None, "counts": {}})

    def clear(self, m: Manifest | None = None) -> None:
        """No chunks, no hashes, and a manifest that claims none, of the identity of ``m`` or else of the one before."""

        def build(was: dict) -> dict:
            own = asdict(m) if m else was["manifest"]
            none = {"chunk_count": 0, "file_count": 0, "last_full_index_at": None, "last_incremental_at": None, "similarity_floor": None}
            return {"manifest": own and own | none, "chunks": {}, "files": None, "counts": {}}

        self._commit(build)

    def write_manifest(self, m: Manifest) -> None:
        """S13."""
        self._commit(lambda was: was | {"manifest": asdict(m)})

    def sync(self, m: Manifest, now: str, files: DataFrame | None = None) -> Manifest:
        """After a full index: counts are those of what has landed; hashes become ``files``, where these are given."""
        new = None if files is None else self._write_files(files)

        def build(was: dict) -> dict:
            counts = [sum(c[k] for c in was["counts"].values()) for k in (0, 1)]
            more = {"chunk_count": counts[0], "file_count": counts[1], "last_full_index_at": now, "last_incremental_at": now}
            return was | {"manifest": asdict(m) | more} | ({} if new is None else {"files": new})

        return Manifest(**self._commit(build)["manifest"])

    def touch(self, current: DataFrame, model: str, dimensions: int, now: str) -> Manifest | None:
        """If the index is of this model and its hashes are those of ``current``, only its times change; else None."""
        m = self.manifest()
        if m is None or (m.schema_version, m.embedding_model, m.dimensions) != (SCHEMA_VERSION, model, dimensions):
            return None
        if not matches(current, self.files()).first().in_sync:
            return None
        m = replace(m, last_full_index_at=now, last_incremental_at=now)
        self._commit(lambda was: was | {"manifest": was["manifest"] | {"last_full_index_at": now, "last_incremental_at": now}})
        return m

    def set_floor(self, floor: float | None) -> None:
        """S41."""
        if self.manifest() is not None:
            self._commit(lambda was: was | {"manifest": was["manifest"] | {"similarity_floor": floor}})

    def in_step(self) -> bool:
        """The table holds what the manifest claims; no claim is no mismatch."""
        m = self.manifest()
        return m is None or m.chunk_count == 0 or self.count() == m.chunk_count
