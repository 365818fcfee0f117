"""The verbs of an index over one project: build, update, clear, search, look around, ask how it is."""

from __future__ import annotations

import datetime
import logging
import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import config as K
from lodestone.functions import commands
from lodestone.functions import text as X
from lodestone.functions.embedding import Fallback, Http, Model, Provider, Stub, Unavailable, embed
from lodestone.operators import chunking, hints, overview, ranges, similarity
from lodestone.operators import store as S
from lodestone.plans import search as P
from lodestone.sources import files as E
from lodestone.sources import queue_log
from lodestone.streaming import queue, state

#: Hints that go with results.
STALE_HINT = "Some files changed after they were indexed; index again for fresh results."
ENDPOINT_HINT = "The embedding endpoint can't be reached; these are lexical results."
MISMATCH_HINT = "The index is of another embedding model or width; these are lexical results until it is built again."


class NotARepository(ValueError):
    """The project is no git work tree."""


@dataclass(frozen=True)
class Stats:
    """What an index holds after a verb."""

    file_count: int = 0
    chunk_count: int = 0
    warning: str | None = None


@dataclass(frozen=True)
class Found:
    """V1: hits (rank, repo, directory, file_path, language, kind, name, lines, score, stale, snippet) and what went wrong."""

    hits: DataFrame | None
    repo_errors: list[tuple[str, str]] = field(default_factory=list)
    stale_hint: str | None = None
    degraded_hint: str | None = None

    def json(self) -> list[str]:
        """The hits as JSON objects, without fields that are null."""
        return [] if self.hits is None else [r[0] for r in self.hits.select("rank", F.to_json(F.struct(*self.hits.columns)).alias("j")).orderBy("rank").select("j").collect()]

    def groups(self) -> DataFrame | None:
        """Hits by repository and directory, in the order of their best."""
        if self.hits is None:
            return None
        hit = F.struct("rank", "file_path", "language", "kind", "name", "line_start", "line_end", "score", "stale", "snippet")
        groups = self.hits.groupBy("repo", "directory").agg(F.min("rank").alias("best"), F.array_sort(F.collect_list(hit)).alias("hits"))
        return groups.orderBy("best")


def provider_of(c: K.Config, key: str | None = None, assets: str | None = None) -> Provider:
    """Bundled, an endpoint, or an endpoint with the bundled model where both are of one model and width."""
    e = c.embedding
    if e.model.startswith(K.STUB):
        return Stub(e.dimensions, model_id=e.model)

    def model() -> Provider:
        width, pooling, longest = K.MODELS[e.model]
        return Model(e.model, width, pooling, longest, assets or "")

    if e.provider == "bundled":
        return model()
    http = Http(e.endpoint, e.model, e.dimensions, key, e.timeout_ms / 1000)
    fits = e.model in K.MODELS and K.MODELS[e.model][0] == e.dimensions
    return Fallback(http, model()) if fits and assets else http


_PROVIDERS: dict[tuple, Provider] = {}


def cached_provider(c: K.Config, **more) -> Provider:
    """One provider for each configuration of the embeddings, kept for the process."""
    fingerprint = (c.embedding, *sorted(more.items()))
    if fingerprint not in _PROVIDERS:
        _PROVIDERS[fingerprint] = provider_of(c, **more)
    return _PROVIDERS[fingerprint]


def now_utc() -> str:
    return datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


class Engine:
    """An index of the project at ``root``; ``store`` may lie elsewhere, as on a cluster it has to be shared."""

    def __init__(self, spark: SparkSession, root: str, config: K.Config | None = None, provider: Provider | None = None, store: str | None = None, validated: bool = True, buckets: int = 64):
        self.spark, self.root = spark, str(Path(root).resolve())
        self.config = K.validate(config or K.load(f"{self.root}/.lodestone/config.toml"))
        self.provider = provider or cached_provider(self.config)
        self.store = S.Store(spark, store or f"{self.root}/{self.config.paths.index_dir}", buckets)
        if validated and (m := self.store.manifest()) is not None:
            m.check(self.provider.model_id, self.provider.dimensions)

    # -- indexing

    def enumerate(self) -> DataFrame:
        """S3: the files to index, with content and hash."""
        i = self.config.indexing
        return E.enumerate_files(self.spark, self.root, max_kb=i.max_file_size_kb, respect_gitignore=i.respect_gitignore, follow_symlinks=i.follow_symlinks)

    def _rows(self, files: DataFrame) -> DataFrame:
        """Chunks with vectors; the vector goes on with its chunk, so positions need no match."""
        rows = chunking.chunks(files, overlap=self.config.indexing.chunk_overlap_lines)
        return rows.withColumn("vector", embed(F.col("content"), self.provider, self.config.embedding.batch_size)).select(*S.CHUNKS.fieldNames())

    def _fresh(self) -> S.Manifest:
        return S.Manifest(self.provider.model_id, self.provider.dimensions)

    def index(self, now: str | None = None, progress: Callable[[str, int], None] | None = None) -> Stats:
        """Bring the index in step with the files.

        If hashes agree and the table holds what it should, only the times change. Else changed files are chunked and
        embedded again and what is gone goes; nothing else is read or written. Files without chunks keep their hash,
        so that they are not read again; files that were forced in but have no rows are.
        """
        if E.project_root(self.root) != self.root:
            raise NotARepository(f"{self.root} is no git work tree")
        now = now or now_utc()
        say = progress or (lambda what, n: None)
        # the tree is walked and hashed once
        files = self.enumerate()
        current = files.select(F.col("rel_path").alias("file_path"), "file_hash", "force_indexed").persist()
        try:
            found = current.count()
            say("enumerated", found)
            m = self.store.manifest()
            try:
                if m is not None:
                    m.check(self.provider.model_id, self.provider.dimensions)
            except S.IdentityError:  # an index of another schema, model or width is built anew
                self.clear()
                m = self.store.manifest()
            indexed = self.store.paths() if self.store.exists() else None
            forced = current.where("force_indexed").select("file_path")
            again = S.orphans(forced, indexed) if indexed is not None else forced
            sound = self.store.exists() and self.store.in_step()
            same = sound and again.isEmpty() and self.store.touch(current, self.provider.model_id, self.provider.dimensions, now)
            if same:
                return Stats(same.file_count, same.chunk_count, overview.zero_chunks(found, same.chunk_count))
            if not sound:
                self.store.reset()
            stored = self.store.files()
            changed = S.changed_files(current, stored, again).select("file_path", "file_hash").persist()
            say("changed", changed.count())
            gone = S.orphans(stored, current).select("file_path")
            # content is read again for changed files only
            asked = changed.join(current, "file_path").select(F.col("file_path").alias("rel_path"), "force_indexed")
            todo = E.read_files(asked, self.root, self.config.indexing.max_file_size_kb)
            if m is None:
                self.store.write_manifest(self._fresh())
            self._replace(self._rows(todo), changed, gone)
            m = self.store.sync(self.store.manifest(), now)
            changed.unpersist()
            say("indexed", m.chunk_count)
        finally:
            current.unpersist()
        self.store.vacuum()
        if m.chunk_count:
            self.store.set_floor(similarity.corpus_floor(self.store.rows().select("file_path", "chunk_id", "vector")))
        return Stats(m.file_count, m.chunk_count, overview.zero_chunks(found, m.chunk_count))

    def _replace(self, rows: DataFrame, files: DataFrame, gone: DataFrame, **more) -> None:
        """One commit: rows of ``files`` are replaced, their hashes noted, and ``gone`` files go; ``more`` goes into the manifest."""
        touched = files.select("file_path").union(gone.select("file_path"))
        checked = self.store._checked(rows, self.provider.dimensions)
        self.store._rewrite(touched, checked, files.select("file_path", "file_hash"), **more)

    def relative(self, path: str) -> str:
        """A path below the root, from one that may be absolute; ValueError if it leaves it."""
        p = os.path.normpath(os.path.join(self.root, path))
        if p != self.root and not p.startswith(self.root + os.sep):
            raise ValueError(f"{path} is outside the project")
        return os.path.relpath(p, self.root).replace(os.sep, "/")

    def reindex_file(self, path: str, now: str | None = None) -> Stats:
        """One file's chunks are brought up to date; a file that is gone, ignored or too large loses them."""
        return self.reindex([path], now)

    def reindex(self, paths: list[str], now: str | None = None, batch: tuple[str, int] | None = None) -> Stats:
        """As ``reindex_file`` for several files, in one write; files that did not change cost one listing.

        ``batch`` (a stream's name, its batch's number) is noted in the commit itself; a batch that has gone in changes nothing when it runs again.
        """
        if batch is not None and (m := self.store.manifest()) is not None and (m.batches or {}).get(batch[0], -1) >= batch[1]:
            return self.stats()
        i = self.config.indexing
        rules = E.Filter(Path(self.root), i.respect_gitignore)
        wanted = [p for p in dict.fromkeys(map(self.relative, paths)) if rules.watchable(p)]
        if not wanted:
            return self.stats()
        asked = self.spark.createDataFrame([(p,) for p in wanted], "file_path string")
        chosen = self.spark.createDataFrame([(p, rules.forced(p)) for p in wanted if os.path.isfile(f"{self.root}/{p}")], "rel_path string, force_indexed boolean")
        files = E.read_files(chosen, self.root, i.max_file_size_kb)
        current = files.select(F.col("rel_path").alias("file_path"), "file_hash")
        if (m := self.store.manifest()) is None:
            self.store.write_manifest(self._fresh())
        else:
            m.check(self.provider.model_id, self.provider.dimensions)
        stored = self.store.files(asked)
        changed = S.changed_files(current, stored)
        gone = S.orphans(stored, current).select("file_path")
        if not (changed.isEmpty() and gone.isEmpty()):
            todo = files.join(changed.select(F.col("file_path").alias("rel_path")), "rel_path", "left_semi")
            noted = {} if batch is None else {"batches": {**(self.store.manifest().batches or {}), batch[0]: batch[1]}}
            self._replace(self._rows(todo), changed, gone, last_incremental_at=now or now_utc(), **noted)
            self.store.vacuum()
        return self.stats()

    def prune(self, now: str | None = None) -> Stats:
        """Rows and hashes of files that are no longer there go."""
        there = E.tree(self.spark, self.root, self.config.indexing.respect_gitignore).select(F.col("rel_path").alias("file_path"))
        gone = S.orphans(self.store.files(), there).select("file_path")
        if not gone.isEmpty():
            self.store.delete(gone)
        return self.stats()

    def clear(self) -> None:
        """Nothing is left of the index, nor of the model and width that it was of."""
        self.store.clear(self._fresh())

    def stats(self) -> Stats:
        m = self.store.manifest()
        return Stats(m.file_count, m.chunk_count) if m else Stats()

    # -- asking

    def search(self, query: str, top_k: int | None = None, languages: list[str] | None = None, prefix: str | None = None, repos: list[str] | None = None, vector: list[float] | None = None) -> Found:
        """V1-V3: the best hit of each file in this index and those of other repositories.

        An index of another model or width, or an endpoint that is down, leaves a lexical search with a hint; a
        repository that can't be read is an entry of ``repo_errors`` and the rest is searched.
        """
        K.check_query(query, top_k)
        s = self.config.settings().with_top_k(top_k or 0)
        languages = [X.language_alias(x) for x in languages] if languages else None
        corpora, errors = self._corpora(K.repositories(self.config.search.cross_repos, repos))
        hint = None
        if vector is None:
            try:
                if (m := self.store.manifest()) is not None:
                    m.check(self.provider.model_id, self.provider.dimensions)
                [vector] = self.provider.embed([query])
            except (S.ModelMismatch, S.WidthMismatch):
                hint = MISMATCH_HINT
            except Unavailable:
                hint = ENDPOINT_HINT
        if vector is not None and (len(vector) != self.provider.dimensions or not all(abs(x) < float("inf") for x in vector)):
            raise ValueError(f"the query vector is not {self.provider.dimensions} finite numbers")
        if corpora is None:
            return Found(None, errors, None, hint)
        best = P.search(corpora, query, vector, languages, prefix, s)
        keys = ["repo", "file_path", "chunk_id"]
        # at most top_k hits; what they show is fetched for them alone
        shown = corpora.select(*keys, "language", "kind", "name", "line_start", "line_end", "file_hash", "content")
        hits = shown.join(F.broadcast(best.select("rank", "directory", "score", *keys)), keys)
        stale = self._stale(hits.select(*keys, "file_hash"))
        hits = hits.join(F.broadcast(stale), keys, "left").withColumn("snippet", X.snippet(F.col("content")))
        hits = hits.select("rank", "repo", "directory", "file_path", "language", "kind", "name", "line_start", "line_end", "score", F.coalesce("stale", F.lit(False)).alias("stale"), "snippet").orderBy("rank")
        return Found(hits, errors, None if stale.where("stale").isEmpty() else STALE_HINT, hint)

    def _corpora(self, repos: list[str]) -> tuple[DataFrame | None, list[tuple[str, str]]]:
        """The rows of this index and of every other repository that can be read."""
        loaders: dict[str, Callable[[], DataFrame]] = {}
        for r in repos:
            own = str(Path(r).resolve())
            if own != self.root:
                loaders[own] = lambda own=own: self._foreign(own)
        others, errors = E.union_repos(loaders)
        mine = self.store.rows().withColumn("repo", F.lit(self.root)) if self.store.exists() else None
        if others is not None:
            others = others.drop("repo_ord")
            mine = others if mine is None else mine.unionByName(others)
        return mine, errors

    def _foreign(self, root: str) -> DataFrame:
        """Another repository's rows, read only; its identity has to be that of this index."""
        c = K.load(f"{root}/.lodestone/config.toml")
        other = S.Store(self.spark, f"{root}/{c.paths.index_dir}")
        m = other.manifest()
        if m is None or m.chunk_count == 0:
            raise LookupError("not indexed")
        m.check(self.provider.model_id, self.provider.dimensions)
        rows = other.rows()
        if rows.isEmpty():
            raise LookupError("index chunks missing")
        return rows

    def _stale(self, hits: DataFrame) -> DataFrame:
        """Of at most top_k hits, whether their file is gone, too large or changed since; hits read once here."""
        from xxhash import xxh3_128_digest

        most, out = self.config.indexing.max_file_size_kb * 1024, []
        for h in hits.collect():
            p = Path(h.repo) / h.file_path
            gone = not p.is_file() or p.stat().st_size > most
            out.append((h.repo, h.file_path, h.chunk_id, gone or xxh3_128_digest(p.read_bytes()) != bytes(h.file_hash)))
        return self.spark.createDataFrame(out, "repo string, file_path string, chunk_id long, stale boolean")

    def duplicates(self, min_similarity: float = similarity.DUPLICATES_MIN, limit: int = similarity.DUPLICATES_LIMIT, cross_repo: bool = False, repos: list[str] | None = None) -> DataFrame:
        """V4."""
        K.check_duplicates(min_similarity, limit)
        rows, _ = self._corpora(K.repositories([], repos))
        return similarity.duplicate_pairs(rows if rows is not None else self.store.rows(), min_similarity, limit, cross_repo=cross_repo)

    def related(self, path: str, vectors: list[list[float]] | None = None) -> DataFrame:
        """V5: the neighbours of a file's chunks, above the corpus floor, deep enough for what will be suppressed."""
        path, h = self.relative(path), self.config.hooks
        m = self.store.manifest()
        floor = similarity.resolve_floor(h.related_min_similarity, m.similarity_floor if m else None)
        rows = self.store.rows()
        if vectors is None:
            vectors = [list(r.vector) for r in self.store.file(path).select("vector").collect()]
        depth = h.related_top_k * similarity.RELATED_DEPTH
        return similarity.neighbours(rows, vectors, F.col("file_path") == path, depth, floor)

    def after_edit(self, path: str, session: str | None, seen: DataFrame | None = None, read: DataFrame | None = None, now: str | None = None) -> DataFrame:
        """One edited file is brought up to date, and what else its session may want to look at is given.

        Asked with are the innermost chunks whose content the file did not have before; of their neighbours above the corpus floor the session sees the best that it
        was not shown (``seen``: session, file_path, name, lines) and has not read (``read``: session, file_path, lines). No session, no hints.
        Columns as of ``hints.fresh``; ``hints.contexts`` puts them into words.
        """
        path = self.relative(path)
        digest = lambda rows: rows.withColumn("content_hash", F.sha2("content", 256))
        before = digest(self.store.file(path)).select("file_path", "content_hash")
        self.reindex([path], now)
        asked = ranges.innermost(ranges.changed(digest(self.store.file(path)), before)) if session is not None else self.store.rows().limit(0)
        vectors = [list(r.vector) for r in asked.select("vector").collect()]  # the chunks of one edit
        known = "session string, file_path string, name string, line_start long, line_end long"
        seen = seen if seen is not None else self.spark.createDataFrame([], known)
        read = read if read is not None else self.spark.createDataFrame([], known).drop("name")
        near = self.related(path, vectors) if vectors else self.store.rows().limit(0).drop("vector").withColumn("score", F.lit(0.0))
        near = near.select(F.lit(session).cast("string").alias("session"), F.lit(path).alias("edited_path"), "file_path", "name", "line_start", "line_end", "score")
        there = [(r.file_path,) for r in near.select("file_path").distinct().collect() if os.path.isfile(f"{self.root}/{r.file_path}")]  # at most the depth
        return hints.fresh(near, seen, read, self.spark.createDataFrame(there, "file_path string"), self.config.hooks.related_top_k)

    def intercept(self, tool: str, payload: str) -> str | None:
        """The question that a search tool's JSON input asks, if a search over meaning can stand in for it."""
        if not self.config.hooks.intercept_grep:
            return None
        p = F.lit(payload)
        asks = {"Bash": commands.searched(F.get_json_object(p, "$.command")), "Grep": F.when(~commands.scoped(p), F.get_json_object(p, "$.pattern"))}
        asked = self.spark.range(1).select(asks[tool].alias("asked")).first().asked if tool in asks else None
        if asked is None or self.spark.range(1).select(X.passthrough(F.lit(asked))).first()[0]:
            return None
        return asked

    def follow(self, edits: DataFrame, checkpoint: str, **trigger):
        """A streaming query over edits (path) that brings each batch's files up to date, in one write a batch.

        The write carries the batch's number under the checkpoint's name: a batch that runs again after a failure between the two is known, and left.
        """
        return state.indexer(edits, lambda df, k: self._follow([r.path for r in df.collect()], (checkpoint, k)), checkpoint, **trigger)

    def _follow(self, paths: list[str], batch: tuple[str, int], tries: int = 5, wait: float = 0.25) -> list[str]:
        """R2: one batch; the paths that could not be brought up to date.

        While other writers come first it waits, twice as long each time, and at last fails, so that the batch runs again. A file that cannot be indexed
        holds up no other: the rest go in one by one, and it is left until its next edit.
        """
        for k in range(tries):
            try:
                self.reindex(paths, batch=batch)
                return []
            except S.Conflict:
                if k + 1 == tries:
                    raise
                time.sleep(wait * 2**k)
            except S.IdentityError:
                raise
            except Exception as e:
                logging.getLogger(__name__).warning("batch %s goes in file by file: %s", batch, e)
                break
        left = []
        for path in paths:
            try:
                self.reindex([path])
            except (S.Conflict, S.IdentityError):
                raise
            except Exception as e:
                logging.getLogger(__name__).warning("%s is left: %s", path, e)
                left.append(path)
        return left

    def drain(self, folder: str, checkpoint: str, **trigger):
        """``follow`` the logs of an edit queue, of whose batch each path is brought up to date once."""
        return self.follow(queue.parse(queue_log.stream(self.spark, folder)), checkpoint, **trigger)

    def overview(self, prefix: str | None = None) -> DataFrame:
        """V7."""
        return overview.rollup(self.store.metadata(), prefix)

    def status(self, now: str | None = None) -> dict:
        """V8: what the manifest says, and whether it is due."""
        m = self.store.manifest()
        now = now or now_utc()
        at = m.last_incremental_at if m else None
        due = self.spark.range(1).select(overview.freshness(F.lit(at).cast("string"), X.parse_rfc3339(F.lit(now)), self.config.indexing.reindex_after_hours)).first()[0]
        elapsed = None
        if at:
            seconds = F.unix_timestamp(X.parse_rfc3339(F.lit(now))) - F.unix_timestamp(X.parse_rfc3339(F.lit(at)))
            elapsed = self.spark.range(1).select(X.format_elapsed(seconds)).first()[0]
        return {
            "project_root": self.root, "present": m is not None, "model": m and m.embedding_model, "dimensions": m and m.dimensions,
            "chunk_count": m.chunk_count if m else 0, "file_count": m.file_count if m else 0, "similarity_floor": m and m.similarity_floor,
            "last_full_index_at": m and m.last_full_index_at, "last_incremental_at": at, "updated_ago": elapsed, "due": due,
        }

    def doctor(self, now: str | None = None) -> dict:
        """V8: status, and whether vectors can be had and fit the index."""
        out = self.status(now) | {"provider": self.config.embedding.provider, "healthy": True, "mismatch": False, "error": None}
        try:
            if (m := self.store.manifest()) is not None:
                m.check(self.provider.model_id, self.provider.dimensions)
            self.provider.health_check()
        except S.IdentityError:
            out |= {"healthy": False, "mismatch": True}
        except Exception as e:  # whatever the provider says is the report
            out |= {"healthy": False, "error": str(e)}
        return out
