"""License scans by ordered signature rules, in DataFrame functions only.

A text becomes its lower-case words, each with a space on either side (" cc  by  4  0 "), so that a rule is a
plain regular expression over whole words and neighbours never share a space. Rules are in order: an earlier
one has priority. A rule looks at a text only if it holds the rule's keyword, which all texts that the rule
matches do. Of overlapping detections one is suppressed if its interval lies within another's
that is longer, or as long and of an earlier rule. Everything is row-local: no shuffle, no Python.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrases that every scan counts, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Elements that ``_scanned`` puts into one array at a time.
PART = 256

#: Family, its names and its versions.
FAMILIES = [
    ("gpl", "general public license|gpl", "1|1 0|2|2 0|3|3 0"),
    ("lgpl", "lesser general public license|library general public license|lgpl", "2|2 0|2 1|3|3 0"),
    ("agpl", "affero general public license|agpl", "1|1 0|3|3 0"),
    ("gfdl", "free documentation license|gfdl", "1 1|1 2|1 3"),
    ("apache", "apache", "1 0|1 1|2|2 0"),
    ("mpl", "mozilla public|mpl", "1 0|1 1|2|2 0"),
    ("epl", "eclipse public|epl", "1 0|2 0"),
    ("cddl", "common development and distribution|cddl", "1 0|1 1"),
    ("cpl", "common public|cpl", "0 5|1 0"),
    ("eupl", "european union public|eupl", "1 0|1 1|1 2"),
    ("osl", "open software|osl", "1 0|1 1|2 0|2 1|3 0"),
    ("afl", "academic free|afl", "1 1|1 2|2 0|2 1|3 0"),
    ("artistic", "artistic", "1 0|2 0"),
    ("ofl", "open font|ofl", "1 0|1 1"),
    ("bsl", "boost software|bsl", "1 0"),
    ("busl", "business source|busl", "1 1"),
    ("sspl", "server side public|sspl", "1|1 0"),
    ("elastic", "elastic", "1 0|2 0"),
    ("psf", "python software foundation|psf", "2|2 0"),
    ("php", "php", "3 0|3 01"),
    ("zpl", "zope public|zpl", "1 1|2 0|2 1"),
    ("lppl", "latex project public|lppl", "1 0|1 1|1 2|1 3|1 3c"),
    ("cecill", "cecill", "1 0|1 1|2 0|2 1"),
    ("upl", "universal permissive|upl", "1 0"),
    ("ecl", "educational community|ecl", "1 0|2 0"),
    ("odbl", "open database|odbl", "1 0"),
    ("odc-by", "open data commons attribution|odc by", "1 0"),
    ("ogl", "open government|ogl", "1 0|2 0|3 0"),
    ("rail", "openrail|open rail m|bigscience rail", "1 0"),
    ("llama", "llama community|llama 2 community|llama 3 community", ""),
    ("mit", "mit|expat|x11", ""),
    ("isc", "isc|internet systems consortium", ""),
    ("zlib", "zlib|zlib libpng", ""),
    ("ncsa", "ncsa|university of illinois", ""),
    ("postgresql", "postgresql", ""),
    ("openssl", "openssl", ""),
    ("ms-pl", "microsoft public|ms pl", ""),
    ("ms-rl", "microsoft reciprocal|ms rl", ""),
    ("wtfpl", "wtfpl|do what the fuck you want to public", ""),
    ("unlicense", "unlicense", ""),
    ("ruby", "ruby", ""),
    ("bsd-0-clause", "0bsd|bsd zero clause|zero clause bsd", ""),
    ("bsd-2-clause", "bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd", ""),
    ("bsd-3-clause", "bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd", ""),
    ("bsd-4-clause", "bsd 4 clause|4 clause bsd|four clause bsd|original bsd", ""),
    ("bsd", "bsd", ""),
]
#: Creative Commons elements in short and long form.
COMMONS = {
    "by": "attribution",
    "by sa": "attribution share ?alike",
    "by nd": "attribution no ?deriv(s|atives)",
    "by nc": "attribution non ?commercial",
    "by nc sa": "attribution non ?commercial share ?alike",
    "by nc nd": "attribution non ?commercial no ?deriv(s|atives)",
}
COMMONS_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]
#: Rules that no family covers: label, keyword, words, confidence.
NOTICES = [
    ("cc0", "cc0", "cc0( 1 0)?( universal)?", 0.95),
    ("cc0", "commons", "creative commons zero( v)?( 1 0)?( universal)?", 0.95),
    ("cc0", "waived", "waived all copyright and related( or neighbou?ring)? rights", 0.9),
    ("public-domain", "domain", "(dedicated to|released into|placed in|in|into) the public domain", 0.9),
    ("public-domain", "domain", "public domain (mark|dedication)( 1 0)?", 0.9),
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software", 0.95),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0.95),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted", 0.9),
    ("zlib", "warranty", "this software is provided as is without any express or implied warranty", 0.8),
    ("wtfpl", "fuck", "you just do what the fuck you want to", 0.95),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 0.95),
    ("copyleft", "copyleft", "copyleft( c)?( all wrongs reserved)?", 0.6),
    ("copyright", "copyright", "(c )?copyright (c )?(19|20)[0-9][0-9]( (19|20)[0-9][0-9])*", 0.6),
    ("copyright", "copyright", "copyright( notice| holders?| owners?)", 0.4),
    ("reserved", "reserved", "(all|some|no) rights( are)? reserved", 0.7),
    ("reserved", "reproduced", "no part of this (publication|book|work|document) may be reproduced", 0.8),
    ("reserved", "permission", "(reproduced|reprinted|used) (with|by) permission", 0.5),
    ("proprietary", "proprietary", "proprietary( and| or)? confidential", 0.9),
    ("proprietary", "licen", "(proprietary|commercial) licen[sc]e", 0.7),
    ("non-commercial", "commercial", "(for )?non ?commercial (use|purposes?)( only)?", 0.6),
    ("license", "licen", "(this|the) (work|document|file|software|page|text|content|article|data ?set) is licen[sc]ed( under| to)?", 0.5),
    ("license", "under", "(licen[sc]ed|released|distributed) under( the)?( terms)?", 0.4),
    ("license", "licen", "see (the )?licen[sc]e( file)?( for)?( details)?", 0.4),
]


class Rule(NamedTuple):
    label: str
    keyword: str
    pattern: str
    score: float
    #: Of these a text must hold one besides, where there are any; they are looked for where it holds the keyword.
    second: tuple[str, ...] = ()


def _wide(words: str) -> str:
    """A regular expression over words from one in which a space separates two; " ?" is a gap that may be missing."""
    return words.replace(" ?", "( )?").replace(" ", "  ")


def _held(keyword: str) -> str:
    """A keyword as it stands in spaced words; one that begins with a space is the beginning of a word, one that also ends with one a whole word."""
    words = _wide(keyword.strip(" "))
    return (" " if keyword[0] == " " else "") + words + (" " if keyword[-1] == " " else "")


def rules() -> list[Rule]:
    """The signature rules, first priority first: with a version before without, long forms before short."""
    out: list[Rule] = []

    def add(label: str, keyword: str, words: str, score: float, *second: str) -> None:
        out.append(Rule(label, _held(keyword), f" {_wide(words)} ", score, tuple(map(_held, second))))

    licensed = "(licen[sc]ed|released|distributed|available|published|provided|covered) (under|by) (the )?(terms of (the )?)?(a )?"
    for short, long in COMMONS.items():
        label = "cc-" + short.replace(" ", "-")
        for v in COMMONS_VERSIONS:
            name = f"{label}-{v.replace(' ', '.')}"
            add(name, "commons", f"creative commons( {long})?( license)?( {short})?( version)?( v)? v?{v}( international| unported| generic)?( license)?" if short != "by" else f"creative commons( attribution| by)( license)?( version)?( v)? v?{v}( international| unported| generic)?( license)?", 0.95)
            add(name, f" cc {short} ", f"({licensed}|spdx license identifier )?cc {short}( license)?( version)?( v)? v?{v}( international| unported| generic)?( license)?", 0.95)
        add(label, "commons", f"creative commons ({long}|{short})( license)?", 0.9)
        add(label, f" cc {short} ", f"({licensed})?cc {short}( license)?", 0.85)
    # an abbreviation may have its version glued on, as in gplv3: its keyword is how a word begins
    short = lambda name, versions: bool(versions) and name.isalpha() and len(name) <= 6
    named = [(family, name, f" {name}" if short(name, versions) else f" {name} ", versions.split("|")) for family, names, versions in FAMILIES for name in names.split("|")]
    later = "( or( at your option)?( any)? later( version)?| plus)"
    for family, name, keyword, versions in named:
        glued = keyword[-1] != " "
        whole = [f" {name} "] if glued else []
        first = family.split("-")[0]
        for v in filter(None, versions):
            label = f"{family}-{v.replace(' ', '.')}"
            ways = [*whole, *(f" {name}{x}{v.split()[0]}" for x in ("", "v") if glued)]
            numbered = f"({licensed})?(gnu )?{name}" + ("(v?|( license)?( version)?( v)? v?)" if glued else "( license)?( version)?( v)? v?") + v
            published = f"({licensed})?(gnu )?{name}( license)?( as published by the free software foundation)?( either)?( version)?( v)? v?{v}"
            add(f"{label}-or-later", "spdx", f"spdx license identifier {family.replace('-', ' ')} v?{v}{later}", 1.0, f"identifier {first}")
            add(f"{label}-or-later", keyword, f"({published}|{numbered}){later}" if glued else f"{published}{later}", 1.0, *ways)
            add(label, "spdx", f"spdx license identifier {family.replace('-', ' ')} v?{v}( only)?", 1.0, f"identifier {first}")
            add(label, keyword, f"{numbered}( only)?( license)?", 0.95, *ways)
    for family in dict.fromkeys(x[0] for x in named):
        add(family, "spdx", f"spdx license identifier {family.replace('-', ' ')}", 0.95, f"identifier {family.split('-')[0]}")
    for family, name, keyword, _ in named:
        whole = [f" {name} "] if keyword[-1] != " " else []
        add(family, keyword, f"{licensed}(gnu )?{name}( style| like)?( license)?", 0.9, *whole)
        add(family, keyword, f"(gnu )?{name}( style| like)? licen[sc]e", 0.85, *whole)
    for label, keyword, words, score in NOTICES:
        add(label, keyword, words, score)
    return out


def spaced_words(text: Column) -> Column:
    """Each word with a space on either side, or an empty string if there are no words."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    body = F.trim(F.regexp_replace(lower, NOT_WORD, "  "))
    return F.when(body == "", F.lit("")).otherwise(F.concat(F.lit(" "), body, F.lit(" ")))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _words_in(part: Column) -> Column:
    """Words of a part of spaced words that ends with a word's space."""
    return (F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))) / 2


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` and lambdas in it read it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _scanned(items: Column, state: Column, kind: str, step) -> Column:
    """What a sweep over ``items`` puts out: step(state, item) gives (state, whether something comes out, that).

    The output grows in parts, so that the work is all but linear in the number of items.
    """
    none = F.array().cast(f"array<{kind}>")

    def part(state: Column, some: Column) -> Column:
        def one(a: Column, x: Column) -> Column:
            after, kept, out = step(a["state"], x)
            return F.struct(after.alias("state"), F.when(kept, F.concat(a["out"], F.array(out))).otherwise(a["out"]).alias("out"))

        return F.aggregate(some, F.struct(state.alias("state"), none.alias("out")), one)

    def every(it: Column) -> Column:
        parts = F.sequence(F.lit(0), F.greatest(F.floor((F.size(it) - 1) / PART).cast("int"), F.lit(0)))
        zero = F.struct(state.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("done"))
        more = lambda a, b: _let(part(a["state"], F.slice(it, b * PART + 1, F.lit(PART))), lambda r: F.struct(r["state"].alias("state"), F.concat(a["done"], F.array(r["out"])).alias("done")))
        return F.aggregate(parts, zero, more, lambda a: F.flatten(a["done"]))

    return _let(items, every)


def scan(docs: DataFrame, own: list[Rule] | None = None) -> DataFrame:
    """``docs`` (doc_id, text, ...) with n_words, per-phrase counts and ``found`` for each row.

    found: array of (start, end, rule, label, score), the detections that nothing suppresses, in characters
    of the spaced words. Null, empty and wordless texts have none. Rows are independent: repeated rows
    repeat their result, an empty table gives none, and columns other than doc_id and text are dropped.
    """
    own = rules() if own is None else own
    df = docs.select("doc_id", spaced_words(F.col("text").cast("string")).alias("w"))
    df = df.withColumn("n_words", _words_in(F.col("w")).cast("long"))
    for k, phrase in enumerate(BASE):
        p = F.lit(f" {_wide(phrase)} ")
        has = F.contains("w", p)
        n = (F.length("w") - F.length(F.replace(F.col("w"), p, F.lit("")))) / len(f" {_wide(phrase)} ")
        first = _words_in(F.substring(F.col("w"), F.lit(1), F.instr("w", p) - 1))
        last = F.col("n_words") - _words_in(F.substring_index("w", f" {_wide(phrase)} ", -1)) - len(phrase.split())
        df = df.withColumn(f"b{k}", F.when(has, F.struct(n.cast("long").alias("n"), first.cast("long").alias("first"), last.cast("long").alias("last"))))
    by_word: dict[str, list[str]] = {}
    for k, r in enumerate(own):
        by_word.setdefault(r.keyword, []).append(f"named_struct('rule', {k}, 'pattern', {_quoted(r.pattern)}, 'label', {_quoted(r.label)}, 'score', {r.score}D, 'second', array({', '.join(map(_quoted, r.second)) or "CAST(NULL AS STRING)"}))")
    # one constant, which Spark folds once
    table = F.expr("array(" + ", ".join(f"named_struct('keyword', {_quoted(word)}, 'rules', array({', '.join(some)}))" for word, some in by_word.items()) + ")")
    w = F.col("w")
    # a lambda is evaluated for each element: what it reads from outside has to be a column, not an expression
    rules_held = F.flatten(F.transform(F.filter(table, lambda g: F.contains(w, g["keyword"])), lambda g: g["rules"]))
    df = df.withColumn("fit", F.filter(rules_held, lambda r: F.exists(r["second"], lambda x: F.coalesce(F.contains(w, x), F.lit(True))) & F.regexp_like(w, r["pattern"])))

    def places(r: Column) -> Column:
        between, hits = F.split(w, r["pattern"], -1), F.regexp_extract_all(w, r["pattern"], F.lit(0))
        both = F.zip_with(hits, between, lambda h, b: F.struct(F.coalesce(F.length(b), F.lit(0)).alias("b"), F.length(h).alias("h")))

        def one(at: Column, x: Column):
            start = at + x["b"]
            end = start + F.coalesce(x["h"], F.lit(0))
            return end, x["h"].isNotNull(), F.struct(start.alias("start"), end.alias("end"))

        spans = _scanned(both, F.lit(0), "struct<start:int,end:int>", one)
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), r["rule"].alias("rule"), r["label"].alias("label"), r["score"].alias("score")))

    kind = "struct<start:int,back:int,rule:int,label:string,score:double>"
    # in this order all that can suppress a detection stand before it, and do if one of them ends no sooner
    ordered = F.array_sort(F.flatten(F.transform("fit", places)).cast(f"array<{kind}>"))
    top = _scanned(ordered, F.lit(1), kind, lambda least, x: (F.least(least, x["back"]), x["back"] < least, x))
    found = F.transform(top, lambda x: F.struct(x["start"].alias("start"), (-x["back"]).alias("end"), x["rule"].alias("rule"), x["label"].alias("label"), x["score"].alias("score")))
    none = F.array().cast("array<struct<start:int,end:int,rule:int,label:string,score:double>>")
    return df.withColumn("found", F.coalesce(found, none)).drop("w", "fit")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's labels; rows are independent, and detections that tie on an interval go by the rules' order."""
    df = scan(C.table(spark, sf_dir, "documents"))
    n = len(BASE)
    base = F.array_compact(F.array(*(F.when(F.col(f"b{k}").isNotNull(), F.lit(label)) for k, label in enumerate(BASE.values()))))
    found = F.coalesce(F.transform("found", lambda x: x["label"]), F.array().cast("array<string>"))
    some = [F.col(f"b{k}") for k in range(n)]
    return df.select(
        "doc_id",
        "n_words",
        sum((F.coalesce(b["n"], F.lit(0)) for b in some), F.lit(0)).cast("long").alias("n_base"),
        F.least(*(b["first"] for b in some)).alias("first_word"),
        F.greatest(*(b["last"] for b in some)).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, found)), ",").alias("labels"),
        F.greatest(F.when(F.size(base) > 0, F.lit(0.6)).otherwise(F.lit(0.0)), F.coalesce(F.array_max(F.transform("found", lambda x: x["score"])), F.lit(0.0))).alias("score"),
    )


def sql() -> str:
    """The whole scan as DuckDB SQL: every rule looks at every text, without keywords."""
    own = rules()
    values = ", ".join(f"({k}, {_quoted(r.pattern)}, {_quoted(r.label)}, {r.score}::DOUBLE)" for k, r in enumerate(own))
    phrases = ", ".join(f"({k}, {_quoted(f' {_wide(p)} ')}, {len(p.split())}, {_quoted(label)})" for k, (p, label) in enumerate(BASE.items()))
    return rf"""
WITH rules(rule, pattern, label, score) AS (VALUES {values}),
phrases(k, p, np, label) AS (VALUES {phrases}),
n AS (
  SELECT doc_id, CASE WHEN body = '' THEN '' ELSE ' ' || body || ' ' END AS w FROM (
    SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{NOT_WORD}', '  ', 'g')) AS body FROM documents)),
m AS (SELECT doc_id, w, (length(w) - length(replace(w, ' ', ''))) // 2 AS n_words FROM n),
b AS (
  SELECT doc_id, label, (length(w) - length(replace(w, p, ''))) // length(p) AS n,
    length(regexp_replace(w[1:instr(w, p) - 1], '[^ ]', '', 'g')) // 2 AS first,
    n_words - np - (length(string_split(w, p)[-1]) - length(replace(string_split(w, p)[-1], ' ', ''))) // 2 AS last
  FROM m, phrases WHERE contains(w, p)),
ba AS (SELECT doc_id, sum(n)::BIGINT AS n_base, min(first) AS first_word, max(last) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY 1),
fit AS (SELECT doc_id, rule, label, score, string_split_regex(w, pattern) AS parts, regexp_extract_all(w, pattern) AS hits FROM m, rules WHERE regexp_matches(w, pattern)),
spans AS (
  SELECT doc_id, rule, label, score, s, s + length(hits[i]) AS e FROM (
    SELECT *, (list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0))::BIGINT AS s FROM (
      SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM fit))),
top AS (
  SELECT * FROM spans x WHERE NOT EXISTS (
    SELECT 1 FROM spans y WHERE y.doc_id = x.doc_id AND y.s <= x.s AND y.e >= x.e AND (y.e - y.s > x.e - x.s OR y.rule < x.rule))),
ls AS (SELECT doc_id, label FROM top UNION SELECT doc_id, label FROM b),
la AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM ls GROUP BY 1),
sc AS (SELECT doc_id, max(score) AS score FROM top GROUP BY 1)
SELECT m.doc_id, n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  greatest(CASE WHEN n_base > 0 THEN 0.6 ELSE 0.0 END::DOUBLE, coalesce(score, 0)::DOUBLE) AS score
FROM m LEFT JOIN ba USING (doc_id) LEFT JOIN la USING (doc_id) LEFT JOIN sc USING (doc_id)
"""
