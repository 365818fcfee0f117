"""Cases that once went wrong: kept copies, pages without a body, spellings of licences."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import chunks, extract, licenses

LINE = "say the same ten words over and over once more"


def runs(text, n=50):
    words = (text or "").split()
    return {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}


def made(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice("ab cd ef gh ij kl mn op qr st".split()) + str(rng.randrange(500)) for _ in range(n))


A, B, X, Y, Z = made(1, 30), made(2, 30), made(3, 30), made(4, 30), made(5, 30)
SETS = {
    "a repeated line": [(1, made(10, 60) + "\n" + "\n".join([LINE] * 20)), (2, "\n".join([LINE] * 20) + "\n" + made(11, 60))],
    "one word": [(7, "x " * 400), (9, "x " * 300), (11, made(12, 20) + " x" * 120)],
    # a run that document 2 keeps for 3 overlaps one that 1 keeps
    "overlapping runs": [(1, f"{A} {B}"), (2, f"{A} {B} {X}"), (3, f"{B} {X}"), (4, f"{A} {B} {X} {Y}"), (5, f"{X} {Y} {Z}"), (6, f"{B} {X} {Y} {Z}")],
}


@pytest.mark.parametrize("name", sorted(SETS))
def test_what_several_hold_still_stands_in_one(spark, name):
    rows = SETS[name]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    left = {r.doc_id: r.text for r in chunks.drop_repeats(df).collect()}
    by_run = {}
    for doc, text in rows:
        for r in runs(text):
            by_run.setdefault(r, set()).add(doc)
    shared = {r for r, docs in by_run.items() if len(docs) > 1}
    assert shared and shared <= set().union(*map(runs, left.values()))
    # the first document keeps all it had; of a passage no second copy is left
    first = min(doc for doc, _ in rows)
    assert left[first] == dict(rows)[first]
    held = [r for text in left.values() for r in runs(text) & shared]
    assert len(held) == len(set(held))


def test_random_documents_keep_every_shared_run(spark):
    rng = random.Random(8)
    parts = [made(20 + k, 30) for k in range(8)]
    rows = [(d, " ".join(rng.choice(parts) for _ in range(rng.randrange(2, 7)))) for d in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = [r.text for r in chunks.drop_repeats(df).collect()]
    by_run = {}
    for doc, text in rows:
        for r in runs(text):
            by_run.setdefault(r, set()).add(doc)
    assert {r for r, docs in by_run.items() if len(docs) > 1} <= set().union(*map(runs, left))
    assert sum(len(t.split()) for t in left) < sum(len(t.split()) for _, t in rows) / 2


@pytest.fixture(scope="module")
def model():
    return extract.Model(extract.labelled_pages())


NIGHT, TAIL = "It was a dark night, and the wind blew hard.", "And this is the end of it, as ever."
PAGES = [
    (f"<title>Story</title>{NIGHT} {TAIL}", f"{NIGHT} {TAIL}"),
    (f"<h1>The title</h1>{NIGHT}<p>A second sentence stands here, and it is long.</p>{TAIL}", f"The title\n{NIGHT}\nA second sentence stands here, and it is long.\n{TAIL}"),
    (f"<head><title>t</title><p>{NIGHT}</p>{TAIL}", f"{NIGHT}\n{TAIL}"),
    (f"<html><body><p>{NIGHT}</p></body></html>{TAIL}", f"{NIGHT}\n{TAIL}"),
    ("<html><body><article><h1>How to type</h1><p>Press the <button>Enter</button> key twice, and wait.</p></article></body></html>", "How to type\nPress the Enter key twice, and wait."),
    (f"<html><body><article><h1>Films</h1><p>{NIGHT}</p><object data=x>The film shows a dog that runs, and a cat.</object><noscript><p>The picture shows a harbour, with boats.</p></noscript></article>", f"Films\n{NIGHT}\nThe film shows a dog that runs, and a cat.\nThe picture shows a harbour, with boats."),
    ("text only", "text only"),
    (f"<nav><a href=/>Home</a> <a href=/a>About</a></nav><p>{NIGHT}</p><footer>&copy; 2020 The firm</footer>", NIGHT),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_pages_without_a_body(model, page, text):
    assert model.text(page) == text


#: Sentences as real files have them, and the labels of what stands in them.
SPELLINGS = [
    ("This file is GPLv3.", "gpl-3"), ("Under the GNU GPLv2 or later.", "gpl-2-or-later"), ("Library: LGPLv2.1+", "lgpl-2.1"), ("server code is AGPLv3", "agpl-3"), ("Apache License v2.0", "apache-2.0"),
    ("Photos: CC BY-SA v4.0", "cc-by-sa-4.0"), ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2.0-or-later"), ("SPDX-License-Identifier: GPL-2.0-only", "gpl-2.0"), ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"),
    ("SPDX-License-Identifier: CC-BY-4.0", "cc-by-4.0"), ("Licensed under the LGPL v2.1 or later", "lgpl-2.1-or-later"), ("MPL 2.0 applies", "mpl-2.0"), ("GNU General Public License version 3 or any later version", "gpl-3-or-later"),
]


def test_spellings_of_licences(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(SPELLINGS)], "doc_id long, text string")
    found = {r.doc_id: r.labels for r in licenses.scan(df).select("doc_id", F.transform("found", lambda x: x["label"]).alias("labels")).collect()}
    assert [found[k] for k in range(len(SPELLINGS))] == [[label] for _, label in SPELLINGS]


def test_texts_without_words_pass_the_toxicity_stage(spark, tmp_path):
    """Where the labels cannot be told apart, and most are toxic, empty documents still stay."""
    import corpus_pipeline

    rows = [(k, f"word{k % 3} other{k % 5} thing") for k in range(40)] + [(100, None), (101, ""), (102, " \n\t"), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("own"))
    spark.createDataFrame([(k, 1, 1) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.toxicity(spark, df, str(tmp_path)).collect()
    assert {(r.doc_id, r.text) for r in out} >= set(rows[40:]) and all(r.score == "own" for r in out)
    assert len(out) < len(rows)
