"""Minimum-cost-flow resharding.

Old shard sizes and new capacities are the two sides of a flow network; a byte that stays costs nothing, one
that moves costs one (or what a cost matrix says). The optimal flow tells how many bytes each old shard sends
to each new one. Shards are dealt into blocks by a hash; whole blocks are transferred, and only the blocks at
the border between two targets are split by document, largest document first to the target that lacks most.
The driver sees at most BLOCKS sums for each old shard, however many documents there are.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

#: Documents in a block, and the most blocks of a shard.
BLOCK_ROWS, BLOCKS = 4096, 4096
SHARDS = 8


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]] | None = None) -> list[list[int]]:
    """Units that each supplier sends to each taker at the least cost; all supply is sent.

    Successive shortest paths with potentials (Dijkstra). Without ``cost`` a unit that keeps its index is free
    and any other costs one. Raises ValueError if the capacities are too small.
    """
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the new capacities are smaller than the old shards")
    source, sink = n + m, n + m + 1
    edges: list[list] = []  # to, left, cost; edge e ^ 1 is e's reverse
    out: dict[int, list[int]] = defaultdict(list)

    def add(a: int, b: int, cap: int, price: int) -> int:
        out[a].append(len(edges))
        edges.append([b, cap, price])
        out[b].append(len(edges))
        edges.append([a, 0, -price])
        return len(edges) - 2

    for i, s in enumerate(supply):
        add(source, i, s, 0)
    arcs = [[add(i, n + j, sum(supply), cost[i][j] if cost else int(i != j)) for j in range(m)] for i in range(n)]
    for j, c in enumerate(capacity):
        add(n + j, sink, c, 0)
    potential = [0] * (n + m + 2)
    left = sum(supply)
    while left:
        dist = [float("inf")] * (n + m + 2)
        via: list[int | None] = [None] * (n + m + 2)
        dist[source] = 0
        queue = [(0, source)]
        while queue:
            d, u = heapq.heappop(queue)
            if d > dist[u]:
                continue
            for e in out[u]:
                v, cap, price = edges[e]
                if cap and (nd := d + price + potential[u] - potential[v]) < dist[v]:
                    dist[v], via[v] = nd, e
                    heapq.heappush(queue, (nd, v))
        for v, d in enumerate(dist):
            if d < float("inf"):
                potential[v] += d
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = edges[via[v] ^ 1][0]
        amount = min([left, *(edges[e][1] for e in path)])
        for e in path:
            edges[e][1] -= amount
            edges[e ^ 1][1] += amount
        left -= amount
    return [[edges[e ^ 1][1] for e in row] for row in arcs]


def transfers(blocks: list[tuple[int, int, int]], flow: list[list[int]]) -> tuple[dict[tuple[int, int], int], dict[tuple[int, int], list[tuple[int, int]]]]:
    """Where blocks (old shard, block, bytes) go: whole blocks' targets, and border blocks' [(target, bytes)]."""
    whole: dict[tuple[int, int], int] = {}
    border: dict[tuple[int, int], list[tuple[int, int]]] = {}
    by_shard = defaultdict(list)
    for s, b, n in sorted(blocks):
        by_shard[s].append((b, n))
    for s, own in by_shard.items():
        quota = [[j, n] for j, n in sorted(enumerate(flow[s]), key=lambda x: (x[0] != s, x[0])) if n]
        for b, n in own:
            parts = []
            while n and quota:
                take = min(n, quota[0][1])
                parts.append((quota[0][0], take))
                quota[0][1] -= take
                n -= take
                if not quota[0][1]:
                    quota.pop(0)
            if len(parts) == 1:
                whole[s, b] = parts[0][0]
            else:
                border[s, b] = parts
    return whole, border


def _numbers(rows: list[tuple], names: tuple[str, ...], kind: pa.DataType) -> pa.Table:
    return pa.table({c: pa.array([r[k] for r in rows], kind) for k, c in enumerate(names)})


def reshard(docs: DataFrame, old_shard: F.Column, shards: int, capacities: list[int] | None = None, cost: list[list[int]] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, old_shard, block, shard, slot for each row of ``docs`` (doc_id, text, ...).

    ``old_shard`` is an integer expression, 0 to ``shards`` - 1; ``capacities`` are in bytes (equal if not
    given). A null text has size 1 and checksum 0. Repeated rows are rows of their own; an empty table gives
    none. Which of some equal rows gets which slot is left open.
    """
    spark = docs.sparkSession
    scratch = C.Scratch(spark)
    raw = docs.select(
        C.whole("doc_id").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        old_shard.cast("int").alias("old_shard"),
    )
    raw = scratch.put(raw.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(1024))))
    rows = {r.old_shard: r.n for r in raw.groupBy("old_shard").agg(F.count("*").alias("n")).collect()}
    if set(rows) - set(range(shards)):
        raise ValueError("an old shard is out of range")
    count = F.element_at(F.array(*(F.lit(min(BLOCKS, -(-rows.get(s, 1) // BLOCK_ROWS))) for s in range(shards))), F.col("old_shard") + 1)
    base = raw.withColumn("block", F.pmod(F.xxhash64("doc_id", "size", "text_crc32", "salt"), count).cast("int")).drop("salt")
    sums = [(r.old_shard, r.block, r.b) for r in base.groupBy("old_shard", "block").agg(F.sum("size").alias("b")).collect()]
    sizes = [sum(b for s, _, b in sums if s == x) for x in range(shards)]
    total = sum(sizes)
    capacities = capacities or [total // shards + (j < total % shards) for j in range(shards)]
    whole, border = transfers(sums, min_cost_flow(sizes, capacities, cost))

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        lack = [[-n, j] for j, n in border[int(pdf.old_shard.iloc[0]), int(pdf.block.iloc[0])]]
        heapq.heapify(lack)
        pdf = pdf.sort_values(["size", "doc_id", "text_crc32"], ascending=[False, True, True])
        target = []
        for n in pdf["size"]:
            n = int(n)
            target.append(lack[0][1])
            heapq.heapreplace(lack, [lack[0][0] + n, lack[0][1]])
        return pdf.assign(shard=target)

    placed = [(s, b, j) for (s, b), j in whole.items()] + [(s, b, None) for s, b in border]
    plan = spark.createDataFrame(_numbers(placed, ("old_shard", "block", "shard"), pa.int32()))
    # at most BLOCKS rows a shard
    placed = base.join(F.broadcast(plan), ["old_shard", "block"])
    fine = placed.where("shard is null").drop("shard").groupBy("old_shard", "block")
    fine = fine.applyInPandas(split, "old_shard int, block int, doc_id long, size long, text_crc32 long, shard int")
    placed = placed.where("shard is not null").unionByName(fine)
    if border:
        placed = scratch.put(placed)
    cells = sorted((r.shard, r.old_shard, r.block, r.n) for r in placed.groupBy("shard", "old_shard", "block").agg(F.count("*").alias("n")).collect())
    offsets, at = [], defaultdict(int)
    for j, s, b, n in cells:
        offsets.append((j, s, b, at[j]))
        at[j] += n
    first = spark.createDataFrame(_numbers(offsets, ("shard", "old_shard", "block", "first"), pa.int64()))
    cell = Window.partitionBy("shard", "old_shard", "block").orderBy("doc_id", "size", "text_crc32")
    out = placed.join(F.broadcast(first), ["shard", "old_shard", "block"])
    return out.select("doc_id", "size", "text_crc32", "old_shard", "block", "shard", (F.col("first") + F.row_number().over(cell) - 1).alias("slot"))


JOURNAL, STAGED = "_reshard.json", "_reshard"


def rewrite(spark: SparkSession, root: str, shards: int, capacities: list[int] | None = None) -> list[tuple[int, int, int]]:
    """Reshard files under ``root``/shard=K/ in place; returns the (old, new, bytes) transfers of whole files.

    A file is the block of the flow, its length its size. Files that stay are not touched and files that move
    whole are renamed; only files at a border are read, split by row and written again to their shards. What is to be
    done is in a journal before anything is moved, and split files are written aside first: called again after a crash,
    this goes on where it stopped, and no row is lost or doubled. Nobody may read the shards meanwhile.
    """
    files = _Files(spark, root)
    if files.exists(JOURNAL):
        plan = files.load(JOURNAL)
    else:
        found = sorted((s, name, n) for s in range(shards) for name, n in files.listed(f"shard={s}"))
        sizes = [sum(n for s, _, n in found if s == x) for x in range(shards)]
        total = sum(sizes)
        capacities = capacities or [total // shards + (j < total % shards) for j in range(shards)]
        whole, border = transfers([(s, k, n) for k, (s, _, n) in enumerate(found)], min_cost_flow(sizes, capacities))
        plan = {
            "moves": [[s, j, found[k][2], f"shard={s}/{found[k][1]}", f"shard={j}/from{s}-{found[k][1]}"] for (s, k), j in whole.items() if s != j],
            "splits": [[k, f"shard={s}/{found[k][1]}", found[k][2], parts] for (s, k), parts in border.items()],
            "parts": None,
        }
        files.save(JOURNAL, plan)
    if plan["parts"] is None:
        plan["parts"] = []
        for k, source, n, targets in plan["splits"]:
            df = spark.read.parquet(f"{root}/{source}")
            h = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)), F.lit(1 << 20)) / float(1 << 20)
            low = 0.0
            for x, (j, take) in enumerate(targets):
                high = 1.0 if x == len(targets) - 1 else low + take / n
                aside = f"{STAGED}/{k}-{j}"
                df.where((h >= low) & (h < high)).write.mode("overwrite").parquet(f"{root}/{aside}")
                plan["parts"] += [[f"{aside}/{name}", f"shard={j}/split{k}-{name}"] for name, _ in files.listed(aside)]
                low = high
        files.save(JOURNAL, plan)
    for source, target in [*((m[3], m[4]) for m in plan["moves"]), *plan["parts"]]:
        files.move(source, target)
    files.delete(*(source for _, source, _, _ in plan["splits"]), STAGED, JOURNAL)
    return [tuple(m[:3]) for m in plan["moves"]]


class _Files:
    """Files below a folder of any store that Hadoop knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.hadoop, self.root = spark._jvm.org.apache.hadoop.fs, root
        self.spark, self.fs = spark, self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.hadoop.Path(f"{self.root}/{name}".rstrip("/"))

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def listed(self, folder: str) -> list[tuple[str, int]]:
        """(name, bytes) of a folder's Parquet files."""
        if not self.exists(folder):
            return []
        found = [(x.getPath().getName(), int(x.getLen())) for x in self.fs.listStatus(self._path(folder))]
        return sorted(x for x in found if x[0].endswith(".parquet"))

    def move(self, source: str, target: str) -> None:
        """Once: a source that is gone has been moved before."""
        if self.exists(source):
            self.fs.mkdirs(self._path(target).getParent())
            if not self.fs.rename(self._path(source), self._path(target)):
                raise OSError(f"{source} can't be moved to {target}")

    def delete(self, *names: str) -> None:
        for name in names:
            self.fs.delete(self._path(name), True)

    def load(self, name: str) -> dict:
        stream = self.fs.open(self._path(name))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def save(self, name: str, value: dict) -> None:
        """Written aside, then renamed over what was there."""
        out = self.fs.create(self._path(f"{name}.new"), True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        over = self.spark.sparkContext._gateway.new_array(self.hadoop.Options.Rename, 1)
        over[0] = self.hadoop.Options.Rename.OVERWRITE
        context = self.hadoop.FileContext.getFileContext(self._path(name).toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(self._path(f"{name}.new"), self._path(name), over)


def op3_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old layout has a shard for each hash of the source, so that a large source makes one far too large."""
    old = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(SHARDS))
    out = reshard(C.table(spark, sf_dir, "documents"), old, SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
