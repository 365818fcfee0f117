"""Near-duplicate documents: fast similarity sketching, banding, exact verification on full shingle sets.

A document's set is its distinct shingles of five words. Fast similarity sketching fills T coordinates: in
round i < T each element falls into one hashed bin with a value that rises with the round; in round T + b
every element falls into bin b, so that each coordinate fills, and collisions concentrate as for independent
coordinates. Bands of three coordinates propose links; a pair of similarity 0.75 stays unseen with
probability (1 - 0.75 ** 3) ** 24 = 2e-6, one of 0.8 with 5e-8.

Equal sets are one class before any pair is made. Documents of one band value join its smallest document, so
a band of n documents costs n rows, never n squared; the connected groups of these candidates are then
verified on full sets, small groups in one task each, large ones first against shared pivots and then only
those that no pivot links, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WIDTH = 5
BANDS, ROWS = 24, 3
#: Documents of a candidate group that one task compares with each other.
BLOCK = 256
#: Rounds in which a large candidate group is compared with one of its documents.
PIVOTS = 3


def shingle_sets(column: pa.Array, hashes: C.WordHash, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, _, words in C.word_blocks(column, C.SPACED):
        h = hashes.array(words)
        every = C.shingle_hashes(h, width)
        start = 0
        for end in np.flatnonzero(h == 0):
            if end - start >= width:
                yield np.unique(every[start : end - width + 1])
            else:
                yield C.shingle_hashes(h[start:end], end - start) if end > start else np.empty(0, C.U64)
            start = end + 1


class Sketch:
    """Fast similarity sketching of sets of 64-bit hashes into ``bands`` band values of ``rows`` coordinates."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        self.bands, self.rows, self.t = bands, rows, bands * rows
        self.seeds = C.mix(np.arange(1, 2 * self.t + 1).astype(C.U64) * C.U64(0x9E3779B97F4A7C15))

    def coordinates(self, s: np.ndarray) -> np.ndarray:
        t, top = self.t, C.U64(16)
        out = np.full(t, np.iinfo(np.uint64).max, C.U64)
        if len(s) <= t // 2:
            h = C.mix(s[:, None] ^ self.seeds[None, :t])
            np.minimum.at(out, (h % C.U64(t)).astype(np.int64).ravel(), ((h >> top) | (np.arange(t, dtype=C.U64) << C.U64(48))[None, :]).ravel())
        else:
            for i in range(t):
                h = C.mix(s ^ self.seeds[i])
                np.minimum.at(out, (h % C.U64(t)).astype(np.int64), (h >> top) | (C.U64(i) << C.U64(48)))
                if out.max() != np.iinfo(np.uint64).max:
                    break
        for b in np.flatnonzero(out == np.iinfo(np.uint64).max):
            out[b] = (C.mix(s ^ self.seeds[t + b]) >> top).min() | (C.U64(t + b) << C.U64(48))
        return out

    def band_values(self, s: np.ndarray) -> np.ndarray:
        c = self.coordinates(s).reshape(self.bands, self.rows)
        out = C.mix(np.arange(self.bands).astype(C.U64) + C.U64(977))
        for i in range(self.rows):
            out = C.mix(out * C.U64(0x9E3779B97F4A7C15) + c[:, i])
        return out.view(np.int64)


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, digest, bands) of each row; digest names the set and is null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        C.let_go()
        hashes, sketch = C.WordHash(), Sketch(bands, rows)
        for batch in batches:
            n, digest, values = [], [], []
            for s in shingle_sets(batch.column(1), hashes):
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                if len(s):
                    values.append(sketch.band_values(s))
            if n:
                ends = np.cumsum([0, *(bands if d else 0 for d in digest)]).astype(np.int32)
                flat = np.concatenate(values) if values else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    ["doc_id", "n_shingles", "digest", "bands"],
                )

    return docs.select(C.whole("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>")


def _sets(docs: DataFrame, most: int = 250_000) -> DataFrame:
    """(part, doc_id, grams) of rows of (part, doc_id, text); a batch has about ``most`` shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.let_go()
        hashes = C.WordHash()
        for batch in batches:
            done, sets, n = 0, [], 0

            def out(batch=batch):
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                grams = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                return pa.RecordBatch.from_arrays([*(batch.column(k).slice(done, len(sets)) for k in (0, 1)), grams], ["part", "doc_id", "grams"])

            for s in shingle_sets(batch.column(2), hashes):
                sets.append(s)
                n += len(s)
                if n > most:
                    yield out()
                    done, sets, n = done + len(sets), [], 0
            if sets:
                yield out()

    return docs.mapInArrow(run, "part long, doc_id long, grams array<long>")


def linked(sets: list[np.ndarray], percent: int = 75) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of sets with 100 * intersection >= percent * union."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    grams = np.concatenate(sets)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    count = np.diff(np.append(first, len(grams)))
    shared = np.repeat(count > 1, count)
    owner, column = owner[shared], np.repeat(np.cumsum(count > 1) - 1, count)[shared]
    both = np.zeros((n, n), np.float32)
    step = max(1024, 2_000_000 // n)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        i, j = np.searchsorted(column, [low, low + step])
        m = np.zeros((n, step), np.float32)
        m[owner[i:j], column[i:j] - low] = 1
        both += m @ m.T
    a, b = np.nonzero(np.triu(100 * both >= percent * (sizes[:, None] + sizes[None, :] - both), 1))
    return a, b


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning edges of the links within each run of rows of one (part, i, j)."""

    def out(ids, sets):
        if len(ids) < 2:
            return None
        a, b = linked(sets)
        if not len(a):
            return None
        ids = np.array(ids, np.int64)
        nodes, roots = C.forest(ids[a], ids[b])
        keep = nodes != roots
        return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(roots[keep])], ["u", "v"])

    key, ids, sets = None, [], []
    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
        grams = batch.column(4)
        flat, offsets = grams.values.to_numpy(), grams.offsets.to_numpy()
        for r, (k, d) in enumerate(zip(keys, batch.column(3).to_pylist(), strict=True)):
            if k != key:
                if (x := out(ids, sets)) is not None:
                    yield x
                key, ids, sets = k, [], []
            ids.append(d)
            sets.append(flat[offsets[r] : offsets[r + 1]].copy())
    if (x := out(ids, sets)) is not None:
        yield x


def verified_links(sets: DataFrame, scratch: C.Scratch) -> DataFrame:
    """Spanning edges of all links within each part of ``sets`` (part, doc_id, grams); a written table."""
    size = sets.groupBy("part").agg(F.count("*").alias("n"))
    large = scratch.put(size.where(F.col("n") > BLOCK))
    spread = sets.join(large, "part", "left_anti").select("part", F.lit(0).alias("i"), F.lit(0).alias("j"), "doc_id", "grams")
    edges = None
    if not large.isEmpty():
        held = scratch.put(sets.join(large.select("part"), "part").withColumn("label", F.lit(None).cast("long")))
        for _ in range(PIVOTS):
            # the part's smallest document without a label is compared with all others without one
            free = held.where("label is null")
            pivot = free.groupBy("part").agg(F.min("doc_id").alias("p"))
            pivot = free.select("part", F.col("doc_id").alias("p"), F.col("grams").alias("g")).join(pivot, ["part", "p"]).dropDuplicates(["part"])
            both = F.size(F.array_intersect("grams", "g"))
            link = 100 * both >= 75 * (F.size("grams") + F.size("g") - both)
            label = F.coalesce("label", F.when(F.col("p").isNotNull() & link, F.col("p")))
            after = scratch.put(held.join(pivot, "part", "left").select("part", "doc_id", "grams", label.alias("label")))
            scratch.drop(held)
            held = after
        edges = held.where("label <> doc_id").select(F.col("doc_id").alias("u"), F.col("label").alias("v"))
        # all but the part's largest label meet everything of the part, in blocks
        most = held.where("label is not null").groupBy("part", "label").agg(F.count("*").alias("c"))
        most = most.groupBy("part").agg(F.max_by("label", F.struct("c", "label")).alias("most"), F.max("c").alias("c"))
        half = BLOCK // 2
        held = held.join(large.join(most, "part"), "part").withColumns({"opened": F.ceil((F.col("n") - F.col("c")) / half), "closed": F.ceil(F.col("c") / half)})
        h = F.xxhash64("doc_id", F.size("grams"))
        b = F.when(F.col("label") == F.col("most"), F.col("opened") + F.pmod(h, "closed")).otherwise(F.pmod(h, "opened"))
        held = held.where("opened > 0").withColumn("b", b)
        meets = F.filter(F.sequence(F.lit(0).cast("long"), F.col("opened") + F.col("closed") - 1), lambda x: (x < F.col("opened")) | (F.col("b") < F.col("opened")))
        held = held.withColumn("x", F.explode(meets))
        spread = spread.union(held.select("part", F.least("b", "x").alias("i"), F.greatest("b", "x").alias("j"), "doc_id", "grams"))
    n = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rest = spread.repartition(n, "part", "i", "j").sortWithinPartitions("part", "i", "j").select("part", "i", "j", "doc_id", "grams")
    links = rest.mapInArrow(_verify, "u long, v long")
    return scratch.put(links if edges is None else links.union(edges))


def near_duplicates(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text, ...).

    A null, empty or blank text has no shingles and links with nothing; a text of one to four words has one.
    Rows that share a doc_id share a component. A null doc_id takes the component of its copies, else null,
    and is not kept. Further columns of ``docs`` are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = C.Scratch(spark)
    docs = docs.select(C.whole("doc_id").alias("doc_id"), "text")
    sketch = scratch.put(sketches(docs, bands, rows))
    n = sketch.count()
    classes = scratch.put(sketch.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep")).where("rep is not null"), n)
    reps = sketch.select("digest", F.col("doc_id").alias("rep"), "bands").join(classes, ["digest", "rep"])
    banded = scratch.put(reps.select("rep", F.explode("bands").alias("band")), n * bands)
    low = banded.groupBy("band").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("band", "low")
    near = banded.join(scratch.put(low, n * bands), "band").where("rep <> low").select("rep", "low").distinct()
    parts = scratch.put(C.components(near, scratch, n * bands), n)
    scratch.drop(banded)
    texts = docs.join(C.small(parts.select(F.col("node").alias("doc_id"), F.col("component").alias("part"))), "doc_id")
    sets = scratch.put(_sets(texts.select("part", "doc_id", "text")))
    found = C.components(verified_links(sets, scratch), scratch, n)
    # rows of one doc_id with different texts are one node as well
    of = classes.join(found, classes.rep == found.node, "left").select("digest", F.coalesce("component", "rep").alias("by_text"))
    out = sketch.drop("bands").join(of, "digest", "left")
    own = F.coalesce("by_text", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(False)).alias("kept"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group; of a group the smallest doc_id is kept, rows that tie on it alike."""
    return near_duplicates(C.table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda w: w <> '') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS node, doc_id AS low FROM documents UNION SELECT l.b, r.low FROM reach r JOIN links l ON l.a = r.node),
comp AS (SELECT node, min(low) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN comp c ON c.node = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""
