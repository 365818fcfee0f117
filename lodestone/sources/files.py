"""Enumerating a source tree as a data source: subtrees are partitions, and rule files are read along the path that is walked.

The driver looks at directories until there are enough subtrees to go round, never at files; a task walks its own subtrees, with the rules of the
directories above them. Paths are rows, whose content is read and hashed where it is wanted.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestone.functions import text as X
from lodestone.functions.hashing import xxh3_128

IGNORE, INCLUDE = ".indexignore", ".indexinclude"
MAX_KB = 512


class Rules:
    """Gitignore patterns of one file, matched against paths below its directory; the last match wins."""

    def __init__(self, lines: Iterable[str], base: str = ""):
        self.base = base.strip("/")
        self.rules: list[tuple[re.Pattern, bool, bool]] = []
        for line in lines:
            line = re.sub(r"(?<!\\)\s+$", "", line.rstrip("\n"))
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[1:] if keep else line
            if line.startswith("\\"):
                line = line[1:]
            only_dirs = line.endswith("/")
            line = line.rstrip("/")
            anchored = "/" in line
            self.rules.append((re.compile(("" if anchored else "(?:.*/)?") + self._regex(line.lstrip("/")) + r"\Z", re.S), keep, only_dirs))

    @staticmethod
    def _regex(glob: str) -> str:
        out, k = "", 0
        while k < len(glob):
            c = glob[k]
            if glob.startswith("**/", k):
                out, k = out + "(?:.*/)?", k + 3
            elif glob.startswith("/**", k) and k + 3 == len(glob):
                out, k = out + "/.+", k + 3
            elif c == "*":
                out, k = out + "[^/]*", k + 1
                while k < len(glob) and glob[k] == "*":
                    k += 1
            elif c == "?":
                out, k = out + "[^/]", k + 1
            elif c == "[" and (end := glob.find("]", k + 2)) > 0:
                body = glob[k + 1 : end]
                out, k = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", end + 1
            else:
                if c == "\\" and k + 1 < len(glob):
                    k += 1
                out, k = out + re.escape(glob[k]), k + 1
        return out

    def matches(self, path: str) -> bool | None:
        """True: ignored, False: kept by "!", None: no rule speaks of the path or a parent of it."""
        if self.base:
            if not path.startswith(self.base + "/"):
                return None
            path = path[len(self.base) + 1 :]
        parts = path.split("/")
        verdict = None
        for k in range(1, len(parts) + 1):
            for pattern, keep, only_dirs in self.rules:
                if (k < len(parts) or not only_dirs) and pattern.match("/".join(parts[:k])):
                    verdict = not keep
            if verdict and k < len(parts):
                return True  # what lies below an ignored directory is ignored
        return verdict


class Filter:
    """Nested rule files; an include wins over ignores, a deeper file over a higher one.

    A path is judged by the rule files of the directories above it, from the top down; each is read once, when it is first passed.
    """

    def __init__(self, root: Path, respect_gitignore: bool = True):
        self.root, self.names = Path(root), (".gitignore" if respect_gitignore else None, IGNORE, INCLUDE)
        self.read: dict[str, tuple] = {}

    def _rules(self, folder: str) -> tuple:
        """The git, ignore and include rules of one directory."""
        if folder not in self.read:
            own = []
            for name in self.names:
                f = self.root / folder / name if name else None
                own.append(Rules(f.read_text(errors="replace").splitlines(), folder) if f is not None and f.is_file() else None)
            self.read[folder] = tuple(own)
        return self.read[folder]

    def _verdict(self, kind: int, path: str) -> bool:
        out, parts = False, path.split("/")
        for k in range(len(parts)):
            rules = self._rules("/".join(parts[:k]))[kind]
            if rules is not None and (v := rules.matches(path)) is not None:
                out = v
        return out

    def forced(self, path: str) -> bool:
        return self._verdict(2, path)

    def git_ignored(self, path: str) -> bool:
        return self._verdict(0, path)

    def kept(self, path: str, tracked: Callable[[str], bool] | None = None) -> bool:
        """A file that git tracks is there whatever .gitignore says of it."""
        if self.forced(path):
            return True
        return not self._verdict(1, path) and not (self.git_ignored(path) and not (tracked is not None and tracked(path)))

    def watchable(self, path: str, state: str = ".lodestone") -> bool:
        parts = path.split("/")
        return bool(path) and ".git" not in parts and state not in parts and self.kept(path)


def project_root(path: str) -> str | None:
    """The nearest directory with a valid .git (a file, or a directory with HEAD and objects)."""
    p = Path(path).resolve()
    for d in [p, *p.parents]:
        g = d / ".git"
        if g.is_file() or (g / "HEAD").exists() and (g / "objects").exists():
            return str(d)
        if g.exists():
            return None
    return None


def tracked(root: str) -> set[str]:
    """Paths of the git index of a work tree, versions 2 to 4; none without a readable one."""
    index = Path(root) / ".git" / "index"
    data = index.read_bytes() if index.is_file() else b""
    if data[:4] != b"DIRC":
        return set()
    version, n = struct.unpack(">II", data[4:12])
    out, at, name = set(), 12, b""
    for _ in range(n):
        flags = struct.unpack(">H", data[at + 60 : at + 62])[0]
        start = at + 62 + (2 if version >= 3 and flags & 0x4000 else 0)
        if version == 4:  # how many bytes of the last name go, then what follows them
            drop, start = _varint(data, start)
            end = data.index(b"\0", start)
            name, at = name[: len(name) - drop] + data[start:end], end + 1
        else:
            end = data.index(b"\0", start)
            name, at = data[start:end], at + ((end - at) // 8 + 1) * 8
        out.add(name.decode(errors="surrogateescape"))
    return out


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = data[at] & 127
    while data[at] & 128:
        at += 1
        value = ((value + 1) << 7) | (data[at] & 127)
    return value, at + 1


#: Directories that the driver looks at before subtrees are dealt out, bytes of a batch of contents.
FOLDERS, CONTENT_BYTES = 256, 8 << 20


class Subtree(InputPartition):
    """A directory, with all below it or its own files only."""

    def __init__(self, folder: str, deep: bool):
        self.folder, self.deep = folder, deep


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.respect, self.follow = options.get("gitignore", "true") == "true", options.get("symlinks", "false") == "true"
        self.skip, self.folders = {".git", options.get("state", ".lodestone")}, int(options.get("folders", FOLDERS))

    def _below(self, folder: str) -> list[str]:
        top = os.path.join(self.root, folder) if folder else self.root
        with os.scandir(top) as found:
            return sorted(f"{folder}/{x.name}" if folder else x.name for x in found if x.is_dir(follow_symlinks=False) and x.name not in self.skip)

    def partitions(self) -> list[Subtree]:
        """Subtrees, level by level, until there are enough; what lies between the top and them are directories by themselves."""
        done, level = [], [""]
        while level and len(done) + len(level) < self.folders:
            below = [f for folder in level for f in self._below(folder)]
            done += [Subtree(folder, False) for folder in level]
            level = below
        return done + [Subtree(folder, True) for folder in level]

    def read(self, partition: Subtree) -> Iterator[pa.RecordBatch]:
        top = Path(self.root)
        rules, known = Filter(top, self.respect), []

        def in_git(path: str) -> bool:
            if not known:
                known.append(tracked(self.root))
            return path in known[0]

        def wanted() -> Iterator[tuple[str, bool]]:
            for d, dirs, names in os.walk(top / partition.folder):
                dirs[:] = sorted(x for x in dirs if x not in self.skip) if partition.deep else []
                for n in sorted(names):
                    p = Path(d) / n
                    if p.is_symlink() and not (self.follow and p.resolve().is_relative_to(top)):
                        continue
                    rel = p.relative_to(top).as_posix()
                    if p.is_file() and n not in (".gitignore", IGNORE, INCLUDE) and rules.kept(rel, in_git):
                        yield rel, rules.forced(rel)

        held: list[tuple[str, bool]] = []
        for row in wanted():
            held.append(row)
            if len(held) == 10_000:
                yield self._batch(held)
                held = []
        if held:
            yield self._batch(held)

    @staticmethod
    def _batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_())], ["rel_path", "force_indexed"])


class TreeSource(DataSource):
    """``spark.read.format("lodestone_tree").option("path", root)``: rel_path and force_indexed of the files that the rules keep."""

    @classmethod
    def name(cls) -> str:
        return "lodestone_tree"

    def schema(self) -> str:
        return "rel_path string, force_indexed boolean"

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def tree(spark: SparkSession, root: str, respect_gitignore: bool = True, state: str = ".lodestone", follow_symlinks: bool = False, folders: int = FOLDERS) -> DataFrame:
    """(rel_path, force_indexed) of a tree; hidden files count, .git and the state folder do not."""
    spark.dataSource.register(TreeSource)
    options = {"path": str(Path(root).resolve()), "gitignore": str(respect_gitignore).lower(), "symlinks": str(follow_symlinks).lower(), "state": state, "folders": str(folders)}
    return spark.read.format("lodestone_tree").options(**options).load()


def read_files(chosen: DataFrame, root: str, max_kb: int = MAX_KB, repo: str | None = None) -> DataFrame:
    """Some files (rel_path, force_indexed) below ``root`` with language, hash and content, read by the tasks; those that are gone or too large are left out."""
    top = str(Path(root).resolve())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for k, rel in enumerate(batch.column(0).to_pylist()):
                try:
                    if os.path.getsize(f"{top}/{rel}") > max_kb * 1024:
                        continue
                    with open(f"{top}/{rel}", "rb") as f:
                        held.append((k, f.read()))
                except OSError:  # it went meanwhile
                    continue
                size += len(held[-1][1])
                if size > CONTENT_BYTES:
                    yield out(batch, held)
                    held, size = [], 0
            if held:
                yield out(batch, held)

    def out(batch, held):
        at = pa.array([k for k, _ in held])
        return pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([c for _, c in held], pa.binary()), batch.column(1).take(at)], ["rel_path", "content", "force_indexed"])

    df = chosen.select("rel_path", "force_indexed").mapInArrow(run, "rel_path string, content binary, force_indexed boolean")
    return df.select(F.lit(repo or top).alias("repo"), "rel_path", X.language_of(F.col("rel_path")).alias("language"), xxh3_128(F.col("content")).alias("file_hash"), "force_indexed", "content")


def enumerate_files(spark: SparkSession, root: str, repo: str | None = None, max_kb: int = MAX_KB, **rules) -> DataFrame:
    """S3: files up to a size (inclusive) with language and hash; only those that the rules keep are opened."""
    return read_files(tree(spark, root, **rules), root, max_kb, repo)


def union_repos(loaders: dict[str, callable]) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """The frames of all repositories that load, with their order, and the errors of the rest."""
    out, errors = None, []
    for k, (repo, load) in enumerate(dict(loaders).items()):
        try:
            df = load().withColumns({"repo": F.lit(repo), "repo_ord": F.lit(k)})
        except Exception as e:  # a repository that fails is reported, the others are searched
            errors.append((repo, str(e).splitlines()[0]))
            continue
        out = df if out is None else out.unionByName(df)
    return out, errors
