"""Settings: defaults, TOML files that override them in order, and the checks that a configuration has to pass."""

from __future__ import annotations

import math
import tomllib
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path, PurePosixPath
from typing import Any

from lodestone.operators.chunking import TARGET
from lodestone.operators.similarity import RELATED_MIN, RELATED_TOP_K
from lodestone.plans.search import Settings

#: Models that run in the workers, with the width of their vectors, how tokens are pooled and the longest text in tokens.
MODELS = {
    "gte-modernbert-base": (768, "cls", 2048),
    "bge-small-en-v1.5": (384, "cls", 512),
}
DEFAULT_MODEL = "gte-modernbert-base"
#: Models whose name starts so need no files.
STUB = "stub"


class ConfigError(ValueError):
    """A setting is unknown, of the wrong kind, or out of range."""


@dataclass(frozen=True)
class Embedding:
    provider: str = "bundled"
    endpoint: str = ""
    model: str = DEFAULT_MODEL
    dimensions: int = MODELS[DEFAULT_MODEL][0]
    batch_size: int = 32
    timeout_ms: int = 8_000


@dataclass(frozen=True)
class Indexing:
    respect_gitignore: bool = True
    follow_symlinks: bool = False
    max_file_size_kb: int = 512
    chunk_overlap_lines: int = 5
    reindex_after_hours: int = 24


@dataclass(frozen=True)
class HybridWeights:
    dense: float = Settings.dense_weight
    bm25: float = Settings.bm25_weight
    rrf: float = Settings.rrf_weight


@dataclass(frozen=True)
class Search:
    top_k: int = Settings.top_k
    hybrid_weights: HybridWeights = HybridWeights()
    identifier_boost: float = Settings.boost
    similarity_threshold: float = Settings.similarity_threshold
    min_score: float = Settings.min_score
    cross_repos: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Hooks:
    intercept_grep: bool = True
    auto_reembed_on_edit: bool = True
    auto_index_on_session_start: bool = True
    surface_related_on_edit: bool = True
    surface_related_on_read: bool = False
    related_top_k: int = RELATED_TOP_K
    related_min_similarity: float = RELATED_MIN
    reindex_debounce_secs: int = 10
    reindex_max_wait_secs: int = 60


@dataclass(frozen=True)
class Paths:
    index_dir: str = ".lodestone/index"
    log_dir: str = ".lodestone/logs"


@dataclass(frozen=True)
class Config:
    """All settings; ``load`` reads them from files."""

    watch: bool = False
    development_mode: bool = False
    embedding: Embedding = Embedding()
    indexing: Indexing = Indexing()
    search: Search = Search()
    hooks: Hooks = Hooks()
    paths: Paths = Paths()

    def settings(self) -> Settings:
        """What the search plan needs of it."""
        s, w = self.search, self.search.hybrid_weights
        return Settings(
            top_k=s.top_k, dense_weight=w.dense, bm25_weight=w.bm25, rrf_weight=w.rrf,
            boost=s.identifier_boost, similarity_threshold=s.similarity_threshold, min_score=s.min_score,
        )


def merge(*tables: Mapping[str, Any]) -> dict[str, Any]:
    """Tables laid over each other key by key; a later one wins, lists as wholes."""
    out: dict[str, Any] = {}
    for table in tables:
        for k, v in table.items():
            out[k] = merge(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def _fits(value: Any, default: Any) -> bool:
    if isinstance(default, bool) or isinstance(value, bool):
        return isinstance(default, bool) and isinstance(value, bool)
    if isinstance(default, float):
        return isinstance(value, int | float)
    if isinstance(default, list):
        return isinstance(value, list) and all(isinstance(x, str) for x in value)
    return isinstance(value, type(default))


def build(kind: type, table: Mapping[str, Any], where: str = "") -> Any:
    """A settings object from a table; what the table leaves out has its default. Unknown keys are left alone."""
    if not isinstance(table, Mapping):
        raise ConfigError(f"{where.rstrip('.') or 'the configuration'} must be a table")
    given = {}
    for f in fields(kind):
        if f.name not in table:
            continue
        value, default = table[f.name], getattr(kind(), f.name)
        if is_dataclass(default):
            given[f.name] = build(type(default), value, f"{where}{f.name}.")
        elif not _fits(value, default):
            raise ConfigError(f"{where}{f.name} must be of type {type(default).__name__}, got {value!r}")
        else:
            given[f.name] = float(value) if isinstance(default, float) else value
    return kind(**given)


def inside(path: str) -> bool:
    """Whether a path is relative and never climbs out."""
    p = PurePosixPath(path.replace("\\", "/"))
    return not p.is_absolute() and ".." not in p.parts and not (len(path) > 1 and path[1] == ":")


def problems(c: Config) -> Iterable[str]:
    """What is wrong with a configuration, in the order of the checks."""
    e, i, s, h = c.embedding, c.indexing, c.search, c.hooks
    for name in ("index_dir", "log_dir"):
        if not inside(getattr(c.paths, name)):
            yield f"paths.{name} must be a relative path inside the project root"
    if e.provider not in ("bundled", "http"):
        yield "embedding.provider must be bundled or http"
    if e.provider == "http" and not e.endpoint.strip():
        yield 'embedding.endpoint is required when embedding.provider = "http"'
    if e.provider == "bundled" and not e.model.startswith(STUB):
        if e.model not in MODELS:
            yield f"embedding.model must be one of {', '.join(MODELS)}, got {e.model}"
        elif e.dimensions != MODELS[e.model][0]:
            yield f"embedding.dimensions must be {MODELS[e.model][0]} for {e.model}"
    positive = {
        "embedding.dimensions": e.dimensions, "embedding.batch_size": e.batch_size, "embedding.timeout_ms": e.timeout_ms,
        "indexing.max_file_size_kb": i.max_file_size_kb, "indexing.reindex_after_hours": i.reindex_after_hours,
        "hooks.related_top_k": h.related_top_k, "hooks.reindex_debounce_secs": h.reindex_debounce_secs,
        "hooks.reindex_max_wait_secs": h.reindex_max_wait_secs, "search.top_k": s.top_k,
    }
    yield from (f"{name} must be > 0" for name, value in positive.items() if value <= 0)
    if not 0 <= i.chunk_overlap_lines < TARGET:
        yield f"indexing.chunk_overlap_lines must be less than {TARGET}"
    if h.reindex_max_wait_secs < h.reindex_debounce_secs:
        yield "hooks.reindex_max_wait_secs must be >= hooks.reindex_debounce_secs"
    shares = {"hooks.related_min_similarity": h.related_min_similarity, "search.similarity_threshold": s.similarity_threshold, "search.min_score": s.min_score}
    yield from (f"{name} must be between 0 and 1" for name, value in shares.items() if not 0 <= value <= 1)
    if any(not r.strip() for r in s.cross_repos):
        yield "search.cross_repos entries must be non-empty paths"
    if not (math.isfinite(s.identifier_boost) and s.identifier_boost > 0):
        yield "search.identifier_boost must be a finite positive number"
    weights = [s.hybrid_weights.dense, s.hybrid_weights.bm25, s.hybrid_weights.rrf]
    if not all(map(math.isfinite, weights)):
        yield "search.hybrid_weights components must be finite numbers"
    elif min(weights) < 0:
        yield "search.hybrid_weights components must be >= 0"
    elif not any(weights):
        yield "search.hybrid_weights must not all be zero"


def validate(c: Config) -> Config:
    """``c``, if nothing is wrong with it; else ConfigError with the first problem."""
    for problem in problems(c):
        raise ConfigError(problem)
    return c


def load(*paths: str | Path) -> Config:
    """The configuration of TOML files, later ones over earlier ones; files that do not exist are left out."""
    tables = []
    for p in map(Path, paths):
        if p.exists():
            try:
                tables.append(tomllib.loads(p.read_text(encoding="utf-8")))
            except (tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
                raise ConfigError(f"{p}: {e}") from e
    return validate(build(Config, merge(*tables)))


def repositories(configured: Iterable[str], asked: Iterable[str] | None = None) -> list[str]:
    """Configured and asked-for repositories, each once, in that order."""
    return list(dict.fromkeys([*configured, *(asked or [])]))


def check_query(query: str, top_k: int | None = None) -> None:
    """A search has words, and asks for at least one hit."""
    if not query.strip():
        raise ValueError("the query must not be empty")
    if top_k is not None and top_k <= 0:
        raise ValueError("top_k must be > 0")


def check_duplicates(min_similarity: float, limit: int) -> None:
    """P27."""
    if not (math.isfinite(min_similarity) and 0 <= min_similarity <= 1):
        raise ValueError("min_similarity must be between 0 and 1")
    if limit < 1:
        raise ValueError("limit must be >= 1")
