"""Near-duplicate embeddings: cross-polytope hashing after fast Hadamard rotations.

A rotation is three rounds of random signs and a fast Walsh-Hadamard transform; a vector's hash is the signed
axis it comes nearest to. Two such hashes make a table's bucket; each vector is also put into the buckets of
its two next nearest axes (multiprobe). Candidates share a bucket in which one of them is at home; each is
verified by its cosine in double precision, in the first table and bucket that finds it only, so that links
are counted without ever being listed. Equal vectors of a label are one weighted vector from the start. A
bucket of more than BLOCK vectors is cut into blocks, and every pair of blocks is a task's work of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

LEAST = 0.93
TABLES, HASHES, PROBES = 6, 2, 2
BLOCK = 512


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep lengths; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
    return x.reshape(n, d) / np.sqrt(d)


def cross_polytope(x: np.ndarray, tables: int = TABLES, hashes: int = HASHES, seed: int = 7) -> np.ndarray:
    """Bucket numbers [row, table, 1 + hashes]: a vector's own and, for each hash, the one with its second axis."""
    n, width = x.shape
    d = 1 << max(0, width - 1).bit_length()
    x = np.pad(x, ((0, 0), (0, d - width)))
    rng = np.random.default_rng(seed)
    out = np.zeros((n, tables, 1 + hashes), np.int64)
    at = np.arange(n)
    for t in range(tables):
        axes = []
        for _ in range(hashes):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], d))
            size = np.abs(y)
            first = size.argmax(1)
            size[at, first] = -1
            second = size.argmax(1)
            axes.append([2 * a + (y[at, a] < 0) for a in (first, second)])
        for probe in range(1 + hashes):
            code = np.zeros(n, np.int64)
            for k in range(hashes):
                code = code * (2 * d) + axes[k][int(probe == k + 1)]
            out[:, t, probe] = code
    return out


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, digest, vector, codes) of the vectors that can link."""
    import xxhash

    for batch in batches:
        ids, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        by_width: dict[int, list] = {}
        for r, v in enumerate(batch.column(2).to_pylist()):
            if v and labels[r] is not None and None not in v:
                a = np.array(v, np.float64)
                if np.isfinite(a).all() and a.any():
                    by_width.setdefault(len(a), []).append((r, a + 0.0))
        for width, rows in by_width.items():
            x = np.stack([a for _, a in rows])
            norms = np.sqrt((x * x).sum(1))
            rows = [(r, a) for (r, a), ok in zip(rows, np.isfinite(norms) & (norms > 0), strict=True) if ok]
            if not rows:
                continue
            x = np.stack([a for _, a in rows])
            codes = cross_polytope(x / np.sqrt((x * x).sum(1, keepdims=True))).reshape(len(x), -1)
            own = [labels[r] for r, _ in rows]
            digest = [xxhash.xxh3_128_digest(a.tobytes() + str((lab, width)).encode()) for (_, a), lab in zip(rows, own, strict=True)]
            lists = lambda a, kind: pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel(), kind))
            single = batch.schema.field(2).type.value_type == pa.float32()  # what came as such is not made longer
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[r] for r, _ in rows], pa.int64()), pa.array(own, pa.int64()), pa.array(digest, pa.binary()), lists(x.astype(np.float32) if single else x, pa.float32() if single else pa.float64()), lists(codes, pa.int64())],
                ["vec_id", "label", "digest", "vector", "codes"],
            )


def _first_shared(codes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first table in which each pair shares a bucket that is home to one of them, and the smallest such bucket."""
    table, code = np.full(len(a), -1), np.full(len(a), -1)
    for t in range(codes.shape[1] - 1, -1, -1):
        home_a, home_b = codes[a, t, 0], codes[b, t, 0]
        in_b = (codes[b, t] == home_a[:, None]).any(1)
        in_a = (codes[a, t] == home_b[:, None]).any(1)
        big = np.iinfo(np.int64).max
        low = np.minimum(np.where(in_b, home_a, big), np.where(in_a, home_b, big))
        hit = in_a | in_b
        table[hit], code[hit] = t, low[hit]
    return table, code


def _links(ids, weights, x, codes, blocks, home, cross: bool, table: int, code: int, least: float):
    """(vector, root, links) of one bucket: the links that this bucket is the first to find."""
    norm = np.sqrt((x * x).sum(1))
    unit = x / norm[:, None]
    near = np.triu(unit @ unit.T >= least - 1e-9, 1)
    near &= home[:, None] | home[None, :]
    if cross:
        near &= blocks[:, None] != blocks[None, :]
    a, b = np.nonzero(near)
    if len(a):
        keep = np.einsum("ij,ij->i", x[a], x[b]) / (norm[a] * norm[b]) >= least
        a, b = a[keep], b[keep]
    if len(a):
        t, c = _first_shared(codes, a, b)
        keep = (t == table) & (c == code)
        a, b = a[keep], b[keep]
    if not len(a):
        return None
    n = np.bincount(a, weights[b], len(ids)) + np.bincount(b, weights[a], len(ids))
    nodes, roots = C.forest(ids[a], ids[b])
    order = np.argsort(ids)
    at = order[np.searchsorted(ids[order], nodes)]
    return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots), pa.array(n[at].astype(np.int64))], ["u", "v", "n"])


def near_vectors(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors`` (vec_id, embedding, label, ...).

    Vectors link if their labels are equal and not null, their widths are equal and their cosine in double
    precision is ``least`` or more. A vector that is null, empty, zero or holds null or non-finite components
    links with nothing and is its own component. Repeated rows are vectors of their own; where they share a
    vec_id each shows its smallest component and largest count. A null vec_id takes
    its copies' component, else null. Other columns are not read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = C.Scratch(spark)
    single = dict(vectors.dtypes)["embedding"] == "array<float>"
    embedding = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    label = F.col("label")
    if dict(vectors.dtypes)["label"] not in ("tinyint", "smallint", "int", "bigint"):  # equal labels stay equal
        label = F.when(label.isNotNull(), F.xxhash64(label.cast("string")))
    rows = vectors.select(C.whole("vec_id").alias("vec_id"), label.cast("long").alias("label"), embedding.alias("embedding"))
    hashed = scratch.put(rows.mapInArrow(_hashed, f"vec_id long, label long, digest binary, vector array<{'float' if single else 'double'}>, codes array<long>"))
    classes = scratch.put(hashed.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")))
    alike = classes.where("rep is not null")
    reps = scratch.put(hashed.select("digest", F.col("vec_id").alias("rep"), "label", "vector", "codes").join(alike, ["digest", "rep"]).dropDuplicates(["rep", "digest"]).drop("digest"))
    per = 1 + HASHES
    # a row for each table and probe; equal buckets of one vector count once, its home first
    slot = F.posexplode("codes").alias("slot", "code")
    member = reps.select("rep", "label", "weight", "vector", "codes", slot).withColumns({"t": F.floor(F.col("slot") / per).cast("int"), "probe": F.col("slot") % per})
    key = F.xxhash64("label", F.size("vector"), "t", "code")
    member = member.withColumn("key", key)
    size = member.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK)
    member = member.join(C.small(scratch.put(size)), "key", "left")
    blocks = F.coalesce(F.ceil(F.col("size") / BLOCK), F.lit(1)).cast("int")
    member = member.withColumn("blocks", blocks).withColumn("b", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    member = member.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    member = member.withColumns({"i": F.least("b", "x"), "j": F.greatest("b", "x")})
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    member = member.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def out():
            if len(held) < 2:
                return None
            rep, weight, b, home, x, codes = (list(c) for c in zip(*held, strict=True))
            codes = np.stack(codes).reshape(len(held), -1, per)
            ids = np.array(rep, np.int64)
            return _links(ids, np.array(weight, np.float64), np.stack(x).astype(np.float64), codes, np.array(b), np.array(home), last[1] != last[2], last[3], last[4], least)

        for batch in batches:
            c = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            keys = list(zip(*(c[k].to_pylist() for k in ("key", "i", "j", "t", "code")), strict=True))
            vec, cod = (c[k].values.to_numpy() for k in ("vector", "codes"))
            vo, co = (c[k].offsets.to_numpy() for k in ("vector", "codes"))
            rest = list(zip(*(c[k].to_pylist() for k in ("rep", "weight", "b", "probe")), strict=True))
            for r, k in enumerate(keys):
                if k != last:
                    if (found := out()) is not None:
                        yield found
                    last, held = k, []
                rep, weight, b, probe = rest[r]
                held.append((rep, weight, b, probe == 0, vec[vo[r] : vo[r + 1]].copy(), cod[co[r] : co[r + 1]].copy()))
        if (found := out()) is not None:
            yield found

    cols = ["key", "i", "j", "t", "code", "rep", "weight", "b", "probe", "vector", "codes"]
    links = scratch.put(member.select(*cols).mapInArrow(run, "u long, v long, n long"))
    scratch.drop(reps)
    count = links.groupBy("u").agg(F.sum("n").alias("n"))
    comp = C.components(links.select("u", "v"), scratch, links.count())
    of = classes.join(count, classes.rep == count.u, "left").join(comp, classes.rep == comp.node, "left")
    of = of.select("digest", F.coalesce("component", "rep").alias("by_links"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("found"))
    linked = hashed.select(F.col("vec_id").alias("id"), "digest").join(of, "digest").groupBy("id").agg(F.min("by_links").alias("by_links"), F.max("found").alias("found"))
    out = rows.select("vec_id").join(linked, F.col("vec_id").eqNullSafe(F.col("id")), "left")
    own = F.coalesce("by_links", "vec_id")
    return out.select("vec_id", F.coalesce("found", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its links and group; rows that tie on a vec_id show the same."""
    return near_vectors(C.table(spark, sf_dir, "embeddings"))


SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS node, vec_id AS low FROM embeddings UNION SELECT l.b, r.low FROM reach r JOIN links l ON l.a = r.node),
comp AS (SELECT node, min(low) AS component_id FROM reach GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN comp ON node = vec_id LEFT JOIN n ON a = vec_id
"""
