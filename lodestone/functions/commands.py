"""Search commands of a shell as column expressions, read as far as a search over meaning can stand in for them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Programs that search text.
TOOLS = ["rg", "ripgrep", "grep", "ag", "ack"]
#: Long and short options that ask for something else than matching lines.
OTHER_OUTPUT = [
    "files-with-matches", "files-without-match", "files", "count", "count-matches", "json", "only-matching", "invert-match", "passthru", "passthrough", "quiet",
    "after-context", "before-context", "context", "vimgrep", "no-filename", "with-filename", "stats", "replace", "file",
]
SHORT_OTHER_OUTPUT = ["l", "L", "c", "v", "o", "q", "A", "B", "C", "f"]
#: Long and short options with a value that does not change what is asked.
WITH_VALUE = [
    "type", "type-not", "type-add", "type-clear", "glob", "iglob", "include", "exclude", "include-dir", "exclude-dir", "max-count", "max-depth", "max-filesize", "color", "colors",
    "engine", "encoding", "threads", "sort", "sortr", "pre", "pre-glob", "context-separator", "field-context-separator", "field-match-separator", "dfa-size-limit", "regex-size-limit",
]
SHORT_WITH_VALUE = ["t", "T", "g", "m"]
#: Options whose value is the pattern.
PATTERN, SHORT_PATTERN = ["regex", "regexp"], "e"
#: Fields of a search tool's input that narrow it or ask for another output.
SCOPES = ["path", "include", "glob", "type", "output_mode", "head_limit", "-A", "-B", "-C", "multiline"]

#: A quoted part, an escaped character; a word of them and of plain characters.
QUOTED = r"""'([^']*)'|"((?:\\.|[^"\\])*)"|\\(.)"""
WORD = r"""(?:[^\s'"\\]|'[^']*'|"(?:\\.|[^"\\])*"|\\.)+"""
#: What stands before a command and only changes how it runs.
WRAPPERS = r"^\s*(?:(?:time|nice)\s+|stdbuf(?:\s+-\S+)*\s+|env(?:\s+[^\s=]+=\S*)*\s+)*"
COMMAND = rf"^(?:git\s+grep|{'|'.join(TOOLS)})(?=\s|$)"

_STATE = "struct<next:string,plain:boolean,other:boolean,found:array<string>>"


def _one_of(c: Column, values: list[str]) -> Column:
    return c.isin(values)


def _read(state: Column, word: Column) -> Column:
    """What is known after one more word: what the next one is for, whether options have ended, whether other output is asked for, the patterns and paths."""
    name, given = F.regexp_extract(word, "^--([^=]+)", 1), F.contains(word, F.lit("="))
    flags = F.substring(word, 2, 1 << 20)
    long = word.startswith("--") & (word != "--")
    short = word.startswith("-") & ~word.startswith("--") & (word != "-")
    is_pattern = state["next"] == "pattern"
    value = (state["next"] == "value") & ~state["plain"]
    option = ~state["plain"] & ~value & ~is_pattern
    takes = (long & ~given & _one_of(name, WITH_VALUE)) | (short & _one_of(flags, SHORT_WITH_VALUE))
    asks = (long & ~given & _one_of(name, PATTERN)) | (short & (flags == SHORT_PATTERN))
    own = F.when(long & given & _one_of(name, PATTERN), F.regexp_extract(word, "(?s)^[^=]*=(.*)$", 1)).when(short & flags.startswith(SHORT_PATTERN) & (F.length(flags) > 1), F.substring(flags, 2, 1 << 20))
    odd = (long & _one_of(name, OTHER_OUTPUT)) | (short & F.rlike(flags, F.lit(f"[{''.join(SHORT_OTHER_OUTPUT)}]")))
    found = F.when(is_pattern | state["plain"], word).when(value, F.lit(None)).when(own.isNotNull(), own).when(~long & ~short & (word != "--"), word)
    return F.struct(
        F.when(option & asks, "pattern").when(option & takes, "value").otherwise("").alias("next"),
        (state["plain"] | (option & (word == "--"))).alias("plain"),
        (state["other"] | (option & odd)).alias("other"),
        F.when(found.isNull(), state["found"]).otherwise(F.concat(state["found"], F.array(found))).alias("found"),
    ).cast(_STATE)


def searched(command: Column) -> Column:
    """P20: the pattern that a command line searches for; null if it searches paths, for several patterns or with other output, is no search, or its quotes do not end."""
    line = F.regexp_replace(F.coalesce(command, F.lit("")), WRAPPERS, "")
    whole = ~F.rlike(F.regexp_replace(line, QUOTED, ""), F.lit(r"""['"\\]"""))
    words = F.transform(F.regexp_extract_all(F.regexp_replace(line, COMMAND, ""), F.lit(WORD), F.lit(0)), lambda w: F.regexp_replace(w, QUOTED, "$1$2$3"))
    start = F.struct(F.lit("").alias("next"), F.lit(False).alias("plain"), F.lit(False).alias("other"), F.array().cast("array<string>").alias("found")).cast(_STATE)
    end = F.aggregate(words, start, _read)
    asked = whole & F.rlike(line, F.lit(COMMAND)) & ~end["other"] & (end["next"] != "pattern") & (F.size(end["found"]) == 1)
    return F.when(asked, F.get(end["found"], F.lit(0)))


def scoped(payload: Column) -> Column:
    """Whether a search tool's JSON input has any of the fields that narrow it."""
    out = F.lit(False)
    for name in SCOPES:
        out = out | F.get_json_object(payload, f"$['{name}']").isNotNull()
    return out
