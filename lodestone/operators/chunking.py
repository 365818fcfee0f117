"""Files to chunks: content-defined text windows, Python by its own parser, other languages by scanners.

A scanner masks comments and strings, then reads declarations and brace depth; it is approximate where a full
grammar would be exact. All chunkers share one shell: non-UTF-8 files give nothing, chunks are in byte order.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.hashing import chunk_id
from lodestone.scratch import BATCH_BYTES, text_batches

#: Lines of a text chunk, and of its overlap.
TARGET, OVERLAP = 60, 5


@dataclass(frozen=True)
class Chunk:
    start: int
    end: int
    kind: str
    name: str | None = None


def text_chunks(data: bytes, target: int = TARGET, overlap: int = OVERLAP) -> list[Chunk]:
    """Windows that end at lines whose hash says so, between a quarter and twice the target."""
    import xxhash

    least, most = target // 4, 2 * target
    divisor = target - least
    lines = data.splitlines(keepends=True) if b"\r" not in data else [x for x in re.split(rb"(?<=\n)", data) if x]
    ends, at = [], 0
    for line in lines:
        at += len(line)
        ends.append(at)
    starts = [0, *ends[:-1]]
    out, first = [], 0
    for k, line in enumerate(lines):
        n = k - first + 1
        if (n >= least and xxhash.xxh3_64_intdigest(line) % divisor == divisor - 1) or n >= most or k == len(lines) - 1:
            out.append(Chunk(starts[max(0, first - overlap)], ends[k], "other"))
            first = k + 1
    return out


def python_chunks(data: bytes) -> list[Chunk]:
    """K2: functions and classes, nested ones too; a decorated function also with its decorators, a decorated class not at all."""
    try:
        tree = ast.parse(data)
    except (SyntaxError, ValueError):
        return []
    lines = data.split(b"\n")
    offsets = [0]
    for line in lines:
        offsets.append(offsets[-1] + len(line) + 1)
    at = lambda line, column: offsets[line - 1] + column
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            if kind == "class" and node.decorator_list:
                continue
            end = at(node.end_lineno, node.end_col_offset)
            out.append(Chunk(at(node.lineno, node.col_offset), end, kind, node.name))
            if node.decorator_list and kind == "function":
                d = node.decorator_list[0]
                out.append(Chunk(data.rindex(b"@", 0, at(d.lineno, d.col_offset)), end, kind, None))
    return out


MASK = {
    "c": re.compile(rb"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])'", re.S),
    "tick": re.compile(rb"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S),
    "sql": re.compile(rb"--[^\n]*|/\*.*?(?:\*/|\Z)|'(?:''|[^'])*'|\$(?P<tag>[A-Za-z_]*)\$.*?(?:\$(?P=tag)\$|\Z)", re.S),
}
W = rb"[A-Za-z_][A-Za-z0-9_]*"
MODIFIERS = rb"(?:(?:public|private|protected|internal|static|final|abstract|sealed|virtual|override|async|partial|readonly|export|default|declare|synchronized|native|unsafe|extern)\s+)*"

#: Per language: declarations that a brace body follows (or a semicolon), as (pattern, kind); group n is the name.
DECLARATIONS: dict[str, list[tuple[bytes, str]]] = {
    "rust": [
        (rb"(?:^|(?<=[{};]))[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:default\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+\S+\s+)?fn\s+(?P<n>" + W + rb")", "function"),
        (rb"(?:^|(?<=[{};]))[ \t]*(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<n>" + W + rb")", "struct"),
        (rb"(?:^|(?<=[{};]))[ \t]*(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<n>" + W + rb")", "enum"),
        (rb"(?:^|(?<=[{};]))[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(?P<n>" + W + rb")", "trait"),
        (rb"(?:^|(?<=[{};]))[ \t]*(?:unsafe\s+)?impl\b", "impl"),
        (rb"(?:^|(?<=[{};]))[ \t]*(?:pub(?:\([^)]*\))?\s+)?mod\s+(?P<n>" + W + rb")(?=\s*\{)", "module"),
        (rb"(?:^|(?<=[{};]))[ \t]*macro_rules!\s*(?P<n>" + W + rb")", "macro"),
    ],
    "typescript": [
        (rb"^[ \t]*" + MODIFIERS + rb"function\s*\*?\s*(?P<n>" + W + rb")", "function"),
        (rb"^[ \t]*" + MODIFIERS + rb"class\s+(?P<n>" + W + rb")", "class"),
        (rb"^[ \t]*" + MODIFIERS + rb"interface\s+(?P<n>" + W + rb")", "interface"),
        (rb"^[ \t]*(?:export\s+)?(?:const|let|var)\s+(?P<n>" + W + rb")\s*(?::[^=\n]+)?=\s*(?:async\s+)?(?:\([^()]*\)|" + W + rb")\s*(?::[^=\n]+)?=>", "function"),
        (rb"^[ \t]+" + MODIFIERS + rb"(?:get\s+|set\s+)?(?!(?:if|for|while|switch|catch|return|function|constructor\b(?!\())\b)(?P<n>" + W + rb")\s*\([^;{}]*\)\s*(?::[^;{}=]+)?(?=\{)", "method"),
    ],
    "go": [
        (rb"^func\s+\([^)]*\)\s*(?P<n>" + W + rb")", "method"),
        (rb"^func\s+(?P<n>" + W + rb")", "function"),
        (rb"^[ \t]*(?:type\s+)?" + W + rb"(?:\[[^\]\n]*\])?\s+struct(?=\s*\{)", "struct"),
        (rb"^[ \t]*(?:type\s+)?" + W + rb"(?:\[[^\]\n]*\])?\s+interface(?=\s*\{)", "interface"),
    ],
    "java": [
        (rb"^[ \t]*" + MODIFIERS + rb"(?:class|record)\s+(?P<n>" + W + rb")", "class"),
        (rb"^[ \t]*" + MODIFIERS + rb"@?interface\s+(?P<n>" + W + rb")", "interface"),
        (rb"^[ \t]*" + MODIFIERS + rb"enum\s+(?P<n>" + W + rb")", "enum"),
        (rb"^[ \t]+" + MODIFIERS + rb"(?:<[^>\n]+>\s*)?(?:[A-Za-z_][\w<>\[\],.? ]*\s+)?(?!(?:if|for|while|switch|catch|return|new|else|do|try)\b)(?P<n>" + W + rb")\s*\([^;{}]*\)\s*(?:throws\s+[\w., ]+)?(?=\{)", "method"),
    ],
    "c": [
        (rb"^(?!\s*(?:else|if|for|while|switch|return|typedef)\b)[A-Za-z_][\w\s*]*?[\s*](?P<n>" + W + rb")\s*\([^;{}]*\)\s*(?=\{)", "function"),
        (rb"^[ \t]*(?:typedef\s+)?(?:struct|union)\s*(?P<n>" + W + rb")?\s*(?=\{)", "struct"),
        (rb"^[ \t]*(?:typedef\s+)?enum\s*(?P<n>" + W + rb")?\s*(?=\{)", "enum"),
    ],
    "cpp": [
        (rb"^[ \t]*(?:inline\s+)?namespace\s+(?P<n>[\w:]+)\s*(?=\{)", "module"),
        (rb"^[ \t]*(?:template\s*<[^\n]*>\s*)?class\s+(?P<n>" + W + rb")[^;{()]*(?=\{)", "class"),
        (rb"^[ \t]*(?:typedef\s+)?(?:struct|union)\s*(?P<n>" + W + rb")?[^;{()]*(?=\{)", "struct"),
        (rb"^[ \t]*(?:typedef\s+)?enum\s*(?:class\s+|struct\s+)?(?P<n>" + W + rb")?[^;{()]*(?=\{)", "enum"),
        (rb"^[ \t]*(?!(?:else|if|for|while|switch|return|typedef|namespace|class|struct|enum|union)\b)(?:[\w:<>,*&~\s]*?[\s*&])?(?P<n>(?:[\w<>]+::)*~?" + W + rb"|operator\S+)\s*\([^;{}]*\)\s*(?:const\s*)?(?:noexcept\s*)?(?:override\s*)?(?:final\s*)?(?::[^;{}]*)?(?=\{)", "function"),
    ],
    "csharp": [
        (rb"^[ \t]*namespace\s+(?P<n>[\w.]+)\s*(?=\{)", "module"),
        (rb"^[ \t]*" + MODIFIERS + rb"(?:class|record(?:\s+class)?)\s+(?P<n>" + W + rb")", "class"),
        (rb"^[ \t]*" + MODIFIERS + rb"interface\s+(?P<n>" + W + rb")", "interface"),
        (rb"^[ \t]*" + MODIFIERS + rb"(?:record\s+)?struct\s+(?P<n>" + W + rb")", "struct"),
        (rb"^[ \t]*" + MODIFIERS + rb"enum\s+(?P<n>" + W + rb")", "enum"),
        (rb"^[ \t]+" + MODIFIERS + rb"(?:[A-Za-z_][\w<>\[\],.? ]*\s+)?(?!(?:if|for|foreach|while|switch|catch|return|new|else|using|lock|get|set)\b)(?P<n>" + W + rb")\s*\([^;{}]*\)\s*(?:where\s[^{;]+)?(?:\s*:\s*(?:base|this)\s*\([^)]*\)\s*)?(?=\{|=>)", "method"),
        (rb"^[ \t]+" + MODIFIERS + rb"[A-Za-z_][\w<>\[\],.?]*\s+(?P<n>" + W + rb")\s*(?=\{\s*(?:get|set|init)\b)", "method"),
    ],
}
DECLARATIONS["javascript"] = DECLARATIONS["typescript"]
SQL = re.compile(rb"\bcreate\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?P<k>table|(?:materialized\s+)?view|function|trigger)\s+(?:if\s+not\s+exists\s+)?(?P<n>[\w.\"`\[\]]+)[^;]*;?", re.I)
DEFINE = re.compile(rb"^[ \t]*#[ \t]*define[ \t]+(?P<n>" + W + rb")(?:[^\n]*\\\r?\n)*[^\n]*", re.M)


def _masked(data: bytes, how: str) -> bytes:
    """The code with comments and strings blanked, byte for byte."""
    return MASK[how].sub(lambda m: re.sub(rb"[^\n]", b" ", m[0]), data)


def scanned_chunks(data: bytes, language: str) -> list[Chunk]:
    """K1, K3-K8: declarations and their brace bodies; methods are functions inside an impl or class."""
    code = _masked(data, "tick" if language in ("typescript", "javascript", "go") else "c")
    pairs, stack = {}, []
    for m in re.finditer(rb"[{}]", code):
        if m[0] == b"{":
            stack.append(m.start())
        elif stack:
            pairs[stack.pop()] = m.end()
    found: dict[int, Chunk] = {}
    for pattern, kind in DECLARATIONS[language]:
        for m in re.finditer(pattern, code, re.M):
            brace = code.find(b"{", m.end())
            stop = code.find(b";", m.end())
            if brace < 0 or -1 < stop < brace:
                if stop < 0 or language not in ("rust", "typescript", "javascript"):
                    continue
                end = stop + 1
            elif brace not in pairs:
                continue
            else:
                end = pairs[brace]
                if language in ("c", "cpp") and kind in ("struct", "enum") and b"typedef" in m[0]:
                    end = code.find(b";", end) + 1 or end
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            name = m["n"] if "n" in m.re.groupindex else None
            if name is None and language in ("c", "cpp") and kind in ("struct", "enum"):
                alias = re.match(rb"\s*(" + W + rb")\s*;", code[pairs.get(brace, end) :])
                name = alias[1] if alias else None
            if start not in found:
                found[start] = Chunk(start, end, kind, name.decode() if name else None)
    out = sorted(found.values(), key=lambda c: (c.start, -c.end))
    holders = {"rust": ("impl", "trait"), "cpp": ("class", "struct")}.get(language, ())
    result = []
    held: list[Chunk] = []  # what is open at a declaration, outermost first
    for c in out:
        while held and held[-1].end < c.end:
            held.pop()
        kind = "method" if c.kind == "function" and any(o.kind in holders for o in held) else c.kind
        held.append(c)
        start = c.start
        if language == "rust":  # doc comments above belong to the item
            while (line := data[:start].rstrip(b" \t")).endswith(b"\n") and data[(up := line[:-1].rfind(b"\n") + 1) : len(line) - 1].lstrip()[:3] in (b"///", b"//!"):
                start = up + len(data[up:]) - len(data[up:].lstrip(b" \t"))
        result.append(Chunk(start, c.end, kind, c.name))
    if language in ("c", "cpp"):
        result += [Chunk(m.start(), m.end(), "macro", m["n"].decode()) for m in DEFINE.finditer(code)]
    return result


def sql_chunks(data: bytes) -> list[Chunk]:
    """K9."""
    out = []
    for m in SQL.finditer(_masked(data, "sql")):
        kind = m["k"].lower().split()[-1].decode()
        out.append(Chunk(m.start(), m.end(), kind, m["n"].decode().strip("\"`[]")))
    return out


#: A chunker for each language.
CHUNKERS: dict[str, Callable[[bytes], list[Chunk]]] = {"python": python_chunks, "sql": sql_chunks} | {k: (lambda data, k=k: scanned_chunks(data, k)) for k in DECLARATIONS}


def chunk_file(data: bytes, language: str, forced: bool = False, overlap: int = OVERLAP) -> list[Chunk]:
    """K0: a file's chunks in byte order; unknown languages only if forced, as text; non-UTF-8 never."""
    try:
        data.decode()
    except UnicodeDecodeError:
        return []
    if language in CHUNKERS:
        found = CHUNKERS[language](data)
    else:
        found = text_chunks(data, overlap=overlap) if forced else []
    return sorted(found, key=lambda c: (c.start, c.end))


def chunks(files: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """Chunk rows of ``files`` (repo, rel_path, language, file_hash, force_indexed, content).

    Files go to Python in batches of bounded bytes and are taken one by one; chunks leave it as soon as a few megabytes are full.
    """
    text_batches(files.sparkSession)
    schema = "repo string, file_path string, byte_start long, byte_end long, line_start long, line_end long, chunk_id long, language string, kind string, name string, file_hash binary, content string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for k in range(batch.num_rows):
                repo, path, language, digest, forced, data = (c[k].as_py() for c in batch.columns)
                for c in chunk_file(data or b"", language, bool(forced), overlap):
                    body = data[c.start : c.end]
                    first = data.count(b"\n", 0, c.start) + 1
                    last = first + body.rstrip(b"\n").count(b"\n")  # W12
                    rows.append((repo, path, c.start, c.end, first, last, chunk_id(digest, c.start, c.end), language, c.kind, c.name, digest, body.decode(errors="replace")))
                    held += len(body)
                    if held >= BATCH_BYTES:
                        yield given(rows)
                        rows, held = [], 0
            if rows:
                yield given(rows)

    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    arrow = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])

    def given(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return files.select("repo", "rel_path", "language", "file_hash", F.col("force_indexed"), F.col("content").cast("binary")).mapInArrow(run, schema)


#: Chunks and bytes of text at which an indexing window is full.
WINDOW_CHUNKS, WINDOW_BYTES = 2000, 16 << 20


def windows(files: Iterator[tuple], chunks: int = WINDOW_CHUNKS, size: int = WINDOW_BYTES) -> Iterator[list[tuple]]:
    """Files (any, chunks, bytes) in windows that end with the file that fills them; files stay whole."""
    held, n, b = [], 0, 0
    for f in files:
        held.append(f)
        n, b = n + f[1], b + f[2]
        if n >= chunks or b >= size:
            yield held
            held, n, b = [], 0, 0
    if held:
        yield held
