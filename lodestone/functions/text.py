"""Column builders over text and paths. ASCII rules are ASCII only: no locale, no Unicode folding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: File extensions by language; anything else is "unknown". Case matters.
EXTENSIONS = {
    "rs": "rust", "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "cs": "csharp", "sql": "sql",
}
#: Names that a language filter may use beside the languages' own.
ALIASES = {"js": "javascript", "ts": "typescript", "c++": "cpp", "c#": "csharp", "cs": "csharp"}
#: Extensions and bare names of documents.
DOC_EXTENSIONS = ("md", "mdx", "markdown", "rst", "txt", "adoc", "asciidoc", "org")
DOC_NAMES = ("readme", "changelog", "license", "contributing")


def tokenize(text: Column) -> Column:
    """maximal runs of ASCII letters and digits, lower-cased."""
    return F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda t: F.translate(t, UPPER, LOWER))


def tokens_of(text: str) -> list[str]:
    """F1 for a query on the driver."""
    import re

    return [t.lower() for t in re.findall("[A-Za-z0-9]+", text)]


def name_hit(name: Column, tokens: list[str]) -> Column:
    """whether the ASCII-lower-cased name contains any token; a null name does not."""
    low = F.translate(F.coalesce(name, F.lit("")), UPPER, LOWER)
    hit = F.lit(False)
    for t in dict.fromkeys(tokens):
        hit = hit | F.contains(low, F.lit(t))
    return hit


def parent_dir(path: Column) -> Column:
    """what precedes the last slash, or "."."""
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit("."))


def forward(path: Column) -> Column:
    """backslashes become slashes."""
    return F.translate(path, "\\", "/")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Text after the last dot of the base name; null without one, or with nothing before it."""
    return F.nullif(F.regexp_extract(base_name(path), r"^.+\.([^.]*)$", 1), F.lit(""))


def language_of(path: Column) -> Column:
    """F5, F25."""
    table = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))
    return F.coalesce(F.element_at(table, F.coalesce(extension(path), F.lit(""))), F.lit("unknown"))


def language_alias(name: str) -> str:
    """a language filter's value; ValueError if there is no such language."""
    low = name.strip().lower()
    low = ALIASES.get(low, low)
    if low != "unknown" and low not in EXTENSIONS.values():
        raise ValueError(f"no such language: {name}")
    return low


#: Kinds of chunks; anything else is "other".
KINDS = ("function", "method", "class", "struct", "enum", "trait", "interface", "impl", "module", "macro", "table", "view", "trigger")


def language_from_storage(name: Column) -> Column:
    """a stored language; "unknown" if it is none."""
    return F.when(name.isin(*sorted(set(EXTENSIONS.values()))), name).otherwise(F.lit("unknown"))


def kind_from_storage(name: Column) -> Column:
    """a stored kind; "other" if it is none."""
    return F.when(name.isin(*KINDS), name).otherwise(F.lit("other"))


def path_prefix(path: Column, prefix: str) -> Column:
    """The path is the prefix, lies under it, or is it with a single extension."""
    prefix = prefix.rstrip("/")
    if not prefix:
        return F.lit(True)
    rest = F.substring(path, len(prefix) + 2, 1 << 30)
    dotted = F.startswith(path, F.lit(prefix + ".")) & ~F.rlike(rest, F.lit("[/.]"))
    return (path == prefix) | F.startswith(path, F.lit(prefix + "/")) | dotted


def is_doc_file(path: Column) -> Column:
    """A document by extension, or by bare name; case does not matter."""
    low = F.translate(base_name(path), UPPER, LOWER)
    ext = F.regexp_extract(low, r"^.*\.([^.]*)$", 1)
    return F.when(F.contains(low, F.lit(".")), ext.isin(*DOC_EXTENSIONS)).otherwise(low.isin(*DOC_NAMES))


def snippet(text: Column, lines: int = 20) -> Column:
    """The first lines, with a line "…" if some are cut; CRLF becomes LF."""
    parts = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n", -1)
    head = F.array_join(F.slice(parts, 1, lines), "\n")
    return F.when(F.size(parts) > lines, F.concat(head, F.lit("\n…"))).otherwise(F.array_join(parts, "\n"))


def unicode_tokens(text: Column) -> Column:
    """how many runs of letters and digits of any script."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def looks_like_regex(text: Column) -> Column:
    """F11."""
    return F.rlike(text, F.lit(r"[\^$\\\[\]()+?{}]|\.\*"))


#: What a query that names files holds, anywhere in it.
TARGETS = ("--glob", "--include", "*.", "src/")
TARGET_EXTENSIONS = (
    ".rs", ".py", ".js", ".mjs", ".cjs", ".ts", ".tsx", ".go", ".java", ".c", ".h", ".cpp",
    ".cc", ".cxx", ".hpp", ".hxx", ".cs", ".sql",
)


def looks_like_target(text: Column) -> Column:
    """names files rather than content."""
    out = F.lit(False)
    for part in (*TARGETS, *TARGET_EXTENSIONS):
        out = out | F.contains(text, F.lit(part))
    return out


#: Names too common to tell which code belongs together, and the shortest name that does.
GENERIC_SYMBOLS = (
    "new", "main", "default", "from", "into", "next", "drop", "clone", "eq", "hash", "cmp", "fmt", "get", "set", "run", "id", "len",
    "add", "build", "parse", "read", "write", "init", "test", "name", "value", "path", "start", "end", "close", "open", "to_string", "as_str",
)
SYMBOL_LENGTH = 4


def evaluable(symbol: Column) -> Column:
    """A symbol long enough, in bytes, and not a generic one."""
    return (F.octet_length(symbol) >= SYMBOL_LENGTH) & ~symbol.isin(*GENERIC_SYMBOLS)


def passthrough(text: Column) -> Column:
    """A search that is not a question: empty, a pattern, a file target, or under three tokens."""
    return (F.trim(text) == "") | looks_like_regex(text) | looks_like_target(text) | (unicode_tokens(text) < 3)


def mentions(text: Column, symbol: Column) -> Column:
    """whether the identifier stands in the text as a whole."""
    quoted = F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), symbol, F.lit(r"\E(?![A-Za-z0-9_])"))
    return F.regexp_like(text, quoted)


def escapes(path: Column) -> Column:
    """Absolute, drive-rooted, or climbing out."""
    return F.rlike(path, F.lit(r"^(/|[A-Za-z]:)|(^|/)\.\.(/|$)"))


def ledger_safe(value: Column) -> Column:
    """neither tab nor newline."""
    return ~F.rlike(value, F.lit(r"[\t\n]"))


def session_suffix(session: Column) -> Column:
    """the first eight bytes of the SHA-256, in hex."""
    return F.substring(F.sha2(session, 256), 1, 16)


def format_elapsed(seconds: Column) -> Column:
    """0s, 4m13s, 3h4m."""
    s = F.greatest(seconds, F.lit(0))
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.concat(m.cast("string"), F.lit("m"), (s % 60).cast("string"), F.lit("s"))).otherwise(F.concat(h.cast("string"), F.lit("h"), m.cast("string"), F.lit("m")))


def rfc3339(ts: Column) -> Column:
    """UTC seconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_rfc3339(text: Column) -> Column:
    """exactly YYYY-MM-DDTHH:MM:SSZ and a real date, else null."""
    ok = F.rlike(text, F.lit(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"))
    return F.when(ok, F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))
