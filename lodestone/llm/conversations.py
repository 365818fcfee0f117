"""Conversation structure repair with one dynamic programme for all conversations that begin alike.

A conversation's signature has a letter a row: its role's initial and its fault. Distinct signatures are dealt out by
ranges and sorted, so those that share a prefix lie side by side; each task walks them as a trie, keeping the layers of
the path it stands on. A layer has, for each state of the pattern (nothing, system, user, assistant), the least cost
and how the state was reached; a signature computes the layers behind the prefix that it shares with the one before,
and its answer is read off at its end. Of equal costs the least text of edits wins. Layers that differ by a constant
cost only are one object, so that a path takes a reference a row, however long the conversation is.

A row is looked at by a digest of its text; texts are exchanged once, for the hash of the repaired conversation,
through which they stream in order. That hash is a chain over a conversation's bytes, so these rows meet in one task,
in batches; everything before it is dealt out by ranges that may end within a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States of the pattern s?(ua)*: what stands last; the next turn of each but by keeping a system's.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Letters of a row: for each initial (system, user, assistant, other) without a fault, truncated, blank, duplicate.
INITIALS, FAULTS = "sua", ("ok", "truncated", "blank", "duplicate")
LETTERS = "abcdefghijklmnop"
#: Letters of a signature that are kept in one piece.
PIECE = 4096

#: White space of the contract, and what is none.
WORDLESS, CLOSED = r"\A[\x20\x09-\x0D]*\z", r"[.!?][\x20\x09-\x0D]*\z"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows after damage by the CRC-32 of ``conv_id:turn``; nulls become one space.

    Modulo 20, 0 drops a row, 1 empties its text, 2 removes its full stops, exclamation and question marks, 3 repeats it, 4 makes it
    the user's. Columns of other names go.
    """
    blank = F.lit(" ")
    rows = conversations.select(C.whole("conv_id"), C.whole("turn"), *(F.coalesce(F.col(c).cast("string"), blank).alias(c) for c in ("role", "text")))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = rows.withColumn("k", F.crc32(key.cast("binary")) % 20)
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.where("k <> 0").select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("k") == 3, 2).otherwise(1).alias("copies"))
    return rows


@dataclass(frozen=True)
class Layer:
    """Costs above the least of the four states (None: out of reach), how each was reached, and how their edits compare.

    came[q] is (state before, edits since); order holds the pairs (p, q) of states of which p's edits so far are less.
    """

    costs: tuple
    came: tuple
    order: frozenset


class Trie:
    """Layers by prefix; ``answer`` takes signatures in sorted order."""

    def __init__(self):
        self.known: dict = {}  # (layer's shape, letter) -> (layer after it, cost added)
        self.path: list[tuple[Layer, int]] = []  # a layer and the cost taken out of it, for each prefix
        self.last = ""
        self.first = self._layer({NOTHING: (0, NOTHING, "")}, None)[0]
        self.layers = 0

    # -- comparison of edits that grow from the states of the layer before -----------------------------

    @staticmethod
    def _less(a: tuple, b: tuple, layer: Layer | None) -> bool:
        """Whether edits a = (state, text) come before b, where texts follow those of the layer's states.

        The edits of a layer's states end with a row's, after as many rows, so none begins with all of another's.
        """
        (p, s), (q, t) = a, b
        return s < t if p == q or layer is None else (p, q) in layer.order

    def _layer(self, best: dict, layer: Layer | None) -> tuple[Layer, int]:
        """A layer of the best ways to states, with inserts before the next row not yet made."""
        least = min(c for c, _, _ in best.values())
        # from the cheapest state one insert leads where any other could, less a system's row kept: what costs more never wins
        best = {q: b for q, b in best.items() if b[0] <= least + INSERT + DELETE}
        came = {q: (p, s) for q, (_, p, s) in best.items()}
        pairs = [(p, q) for p in came for q in came if p != q]
        order = frozenset((p, q) for p, q in pairs if self._less(came[p], came[q], layer))
        costs = tuple(best[q][0] - least if q in best else None for q in range(4))
        return Layer(costs, tuple(came.get(q) for q in range(4)), order), least

    def _ways(self, layer: Layer) -> Iterator[tuple[int, int, int, str]]:
        """(state, cost, state before, inserts) by no insert or up to three."""
        for p, c in enumerate(layer.costs):
            if c is not None:
                q = p
                for k in range(4):
                    yield q, c + INSERT * k, p, "I" * k
                    q = NEXT[q]

    def step(self, layer: Layer, letter: str) -> tuple[Layer, int]:
        """The layer after one more row, and the cost that every way of it has."""
        shape = (layer.costs, layer.order, letter)
        if shape not in self.known:
            role, fault = divmod(LETTERS.index(letter), 4)
            late = TRUNCATED if fault == 1 else 0
            best: dict = {}

            def offer(q, cost, p, text):
                was = best.get(q)
                if was is None or cost < was[0] or cost == was[0] and self._less((p, text), was[1:], layer):
                    best[q] = (cost, p, text)

            for mid, cost, p, text in self._ways(layer):
                offer(mid, cost + DELETE, p, text + "D")
                if fault < 2:
                    if role < 3 and (mid == NOTHING if role == 0 else NEXT[mid] == role + 1):
                        offer(role + 1, cost + late, p, text + "K")
                    offer(NEXT[mid], cost + late + REROLE, p, text + "R")
            self.known[shape] = self._layer(best, layer)
            self.layers += 1
        return self.known[shape]

    def answer(self, signature: str) -> tuple[int, str]:
        """The least cost and the edits of a signature."""
        n, shared = min(len(signature), len(self.last)), 0
        if signature.startswith(self.last):
            shared = len(self.last)
        else:
            while shared < n and signature[shared] == self.last[shared]:
                shared += 1
        del self.path[shared:]
        layer, cost = self.path[-1] if self.path else (self.first, 0)
        for letter in signature[shared:]:
            layer, more = self.step(layer, letter)
            cost += more
            self.path.append((layer, cost))
        self.last = signature
        end = None
        for q, c, p, text in self._ways(layer):
            if q in (NOTHING, ASSISTANT) and (end is None or c < end[0] or c == end[0] and self._less((p, text), end[1:], layer)):
                end = (c, p, text)
        c, state, text = end
        parts = [text]
        for passed, _ in reversed(self.path):
            state, text = passed.came[state]
            parts.append(text)
        return cost + c, "".join(reversed(parts))


def letter(role: Column, blank: Column, again: Column, closed: Column) -> Column:
    """A row's letter."""
    initial = F.substring(role, 1, 1)
    at = F.lit(3)
    for k, i in enumerate(INITIALS):
        at = F.when(initial == i, F.lit(k)).otherwise(at)
    fault = F.when(blank, 2).when(again, 3).when(closed, 0).otherwise(1)
    return F.get(F.lit([*LETTERS]), (at * 4 + fault).cast("int"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, place, letters) of one sorted range of (conv_id, letters): neighbouring rows of a conversation together."""
    from pyspark import TaskContext

    place, held, conv = TaskContext.get().partitionId() << 40, [], None
    size = 0

    def out(rows):
        ids, places, texts = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int64()), pa.array(texts, pa.string())], ["conv_id", "place", "letters"])

    for batch in batches:
        rows = []
        for c, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and (c != conv or size >= PIECE):
                rows.append((conv, place, "".join(held)))
                place, held, size = place + 1, [], 0
            conv = c
            held.append(x)
            size += len(x)
        if rows:
            yield out(rows)
    if held:
        yield out([(conv, place, "".join(held))])


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Faults, cost and edits of sorted signatures."""
    trie = Trie()
    names = ["signature", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    # initials of neighbours that may not follow each other
    legal = {("s", "u"), ("u", "a"), ("a", "u")}
    initial = [*INITIALS, "x"]
    bad = np.array([[(p, q) not in legal for q in initial] for p in initial])
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for signature in batch.column(0).to_pylist():
            at = np.frombuffer(signature.encode(), np.uint8) - ord(LETTERS[0])
            faults = np.bincount(at % 4, minlength=4)
            cost, audit = trie.answer(signature)
            row = (signature, int(faults[2]), int(faults[3]), int(faults[1]), int(bad[at[:-1] // 4, at[1:] // 4].sum()), cost, audit)
            for column, v in zip(out, row, strict=True):
                column.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k in (0, 6) else pa.int64()) for k, c in enumerate(out)], names)


def signatures(rows: DataFrame, scratch: C.Scratch) -> DataFrame:
    """(conv_id, signature) of each conversation of damaged ``rows``."""
    text = F.col("text")
    row = rows.select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), text.rlike(WORDLESS).alias("blank"), text.rlike(CLOSED).alias("closed"), "copies")
    # equal rows of one turn are one, wherever they stand
    row = row.groupBy("conv_id", "turn", "role", "digest").agg(F.sum("copies").alias("copies"), F.first("blank").alias("blank"), F.first("closed").alias("closed"))
    row = scratch.put(row)
    turn = F.struct(F.col("turn").isNotNull().alias("a"), F.coalesce("turn", F.lit(0)).alias("b"))
    again = row.where("not blank").groupBy(*(F.col(c).alias(f"__{c}") for c in ("conv_id", "role", "digest"))).agg(F.min(turn).alias("first"), F.count("*").alias("n")).where("n > 1")
    same = F.col("conv_id").eqNullSafe(F.col("__conv_id")) & (F.col("role") == F.col("__role")) & (F.col("digest") == F.col("__digest"))
    row = row.join(again, same, "left").withColumn("again", F.col("first").isNotNull() & (turn != F.col("first")))
    first = letter(F.col("role"), F.col("blank"), F.col("again"), F.col("closed"))
    later = letter(F.col("role"), F.col("blank"), F.lit(True), F.col("closed"))
    row = row.select("conv_id", "turn", "role", "digest", F.concat(first, F.repeat(later, (F.col("copies") - 1).cast("int"))).alias("letters"))
    order = ["conv_id", "turn", "role", "digest"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = row.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv_id", "letters")
    piece = scratch.put(sorted_rows.mapInArrow(_pieces, "conv_id long, place long, letters string"))
    # a letter a row, as the edits in the result have
    whole = F.array_sort(F.collect_list(F.struct("place", "letters")))
    return piece.groupBy("conv_id").agg(F.concat_ws("", F.transform(whole, lambda x: x["letters"])).alias("signature"))


def solved(found: DataFrame, scratch: C.Scratch) -> DataFrame:
    """Each distinct signature of a written table with its faults, cost and edits."""
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = scratch.put(found.select("signature").distinct())
    dealt = distinct.repartitionByRange(parts, "signature").sortWithinPartitions("signature")
    return scratch.put(dealt.mapInArrow(_answers, "signature string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, repaired_sha256) over sorted rows (conv_id, role, text, copies, audit): a conversation's first row has its edits."""
    state = conv = digest = None
    edits, at, some = "", 0, False

    def put(role, text):
        nonlocal some
        digest.update(("\n" if some else "").encode() + role.encode() + b":" + text.encode())
        some = True

    def inserts():
        nonlocal at, state
        while at < len(edits) and edits[at] == "I":
            state, at = NEXT[state], at + 1
            put(ROLES[state], "")

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["conv_id", "repaired_sha256"])

    for batch in batches:
        done = []
        for c, role, text, copies, audit in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if audit is not None:
                if digest is not None:
                    inserts()
                    done.append((conv, digest.hexdigest()))
                conv, digest, edits, at, state, some = c, hashlib.sha256(), audit, 0, NOTHING, False
                continue
            for _ in range(copies):
                inserts()
                edit, at = edits[at], at + 1
                if edit == "D":
                    continue
                if edit == "R":
                    state = NEXT[state]
                    put(ROLES[state], text)
                else:
                    state = 1 + INITIALS.index(role[0])
                    put(role, text)
        if done:
            yield out(done)
    if digest is not None:
        inserts()
        yield out([(conv, digest.hexdigest())])


def repair(conversations: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation.

    ``rows`` (conv_id, turn, role, text, copies), the damaged ones by default, are repaired; ``conversations`` gives the ids, null
    being one of its own. Rows go by turn, nulls first, then by role and digest of the text; equal rows of one turn stand together.
    A role without a first letter, as any but s, u and a, cannot be kept. A conversation without rows has zeros, no edits
    and the hash of no text; an empty table gives none. Columns of other names are not read.
    """
    scratch = C.Scratch(conversations.sparkSession)
    rows = damaged(conversations) if rows is None else rows
    found = scratch.put(signatures(rows, scratch))
    answers = solved(found, scratch)
    gaps = rows.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"))
    one = scratch.put(found.join(answers, "signature").drop("signature"))
    none = F.lit(None)
    texts = rows.select("conv_id", F.lit(True).alias("row"), "turn", "role", F.sha2("text", 256).alias("digest"), "text", "copies", none.cast("string").alias("audit"))
    heads = one.select("conv_id", F.lit(False).alias("row"), none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("digest"), none.cast("string").alias("text"), F.lit(0).alias("copies"), "audit")
    stream = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "row", "turn", "role", "digest")
    hashes = stream.select("conv_id", "role", "text", "copies", "audit").mapInArrow(_hashes, "conv_id long, repaired_sha256 string")
    out = conversations.select(C.whole("conv_id")).distinct()
    for more in (gaps, one, hashes):
        more = more.select(F.col("conv_id").alias("__id"), *(c for c in more.columns if c != "conv_id"))
        out = out.join(more, F.col("conv_id").eqNullSafe(F.col("__id")), "left").drop("__id")
    zero = F.lit(0).cast("long")
    return out.select(
        "conv_id", *(F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults and cheapest repair."""
    return repair(C.table(spark, sf_dir, "conversations"))


#: CRC-32 in SQL: the table of the reflected polynomial by rule, then a fold over the characters, which are ASCII.
_CRC = """xor(list_reduce([4294967295::bigint] || list_transform(string_split(key, ''), lambda c: ascii(c)::bigint),
    lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295)"""

SQL = f"""
with recursive steps(i, v, k) as (
    select i, i, 0 from range(256) r(i) union all
    select i, case when v & 1 = 1 then xor(v >> 1, 3988292384::bigint) else v >> 1 end, k + 1 from steps where k < 8),
tab as (select list(v order by i) as crc from steps where k = 8),
src as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
hit as (select *, {_CRC} % 20 as k from src, tab),
dam as (select conv_id, turn, case k when 4 then 'user' else role end as role,
    case k when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case k when 3 then 2 else 1 end)) as copy
    from hit where k <> 0),
seq as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), copy) as i from dam),
bad as (select *, not regexp_matches(text, '[^\\x20\\x09-\\x0D]') as blank, row_number() over (partition by conv_id, role, text order by i) > 1 as again,
    not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') as cut, left(role, 1) as c, lag(left(role, 1)) over (partition by conv_id order by i) as b from seq),
way(p, mid, j, ins) as (select p, mid, j, ins from (values
    (0, 0, 0, []), (0, 2, 1, ['user:']), (0, 3, 2, ['user:', 'assistant:']), (0, 2, 3, ['user:', 'assistant:', 'user:']),
    (1, 1, 0, []), (1, 2, 1, ['user:']), (1, 3, 2, ['user:', 'assistant:']), (1, 2, 3, ['user:', 'assistant:', 'user:']),
    (2, 2, 0, []), (2, 3, 1, ['assistant:']), (2, 2, 2, ['assistant:', 'user:']), (2, 3, 3, ['assistant:', 'user:', 'assistant:']),
    (3, 3, 0, []), (3, 2, 1, ['user:']), (3, 3, 2, ['user:', 'assistant:']), (3, 2, 3, ['user:', 'assistant:', 'user:'])) v(p, mid, j, ins)),
edit(mid, op, st, initial, name) as (select * from (values (0, 'K', 1, 's', ''), (0, 'K', 2, 'u', ''), (1, 'K', 2, 'u', ''), (3, 'K', 2, 'u', ''), (2, 'K', 3, 'a', ''),
    (0, 'R', 2, '', 'user'), (1, 'R', 2, '', 'user'), (3, 'R', 2, '', 'user'), (2, 'R', 3, '', 'assistant'),
    (0, 'D', 0, '', ''), (1, 'D', 1, '', ''), (2, 'D', 2, '', ''), (3, 'D', 3, '', '')) v(mid, op, st, initial, name)),
dp as (
    select distinct conv_id, 0::bigint as i, 0 as st, {{'cost': 0::bigint, 'audit': '', 'lines': []::varchar[]}} as best from seq
    union all
    select r.conv_id, r.i, e.st, min({{'cost': dp.best.cost + 2 * j + case op when 'D' then 3 when 'R' then 2 else 0 end + case when op <> 'D' and r.cut then 1 else 0 end,
        'audit': dp.best.audit || repeat('I', j) || op,
        'lines': dp.best.lines || ins || case op when 'D' then [] when 'K' then [r.role || ':' || r.text] else [e.name || ':' || r.text] end}})
    from dp join bad r on r.conv_id is not distinct from dp.conv_id and r.i = dp.i + 1 join way on way.p = dp.st join edit e on e.mid = way.mid
    where (op <> 'K' or r.c = e.initial) and (op = 'D' or not (r.blank or r.again)) group by all),
fin as (select dp.conv_id, min({{'cost': best.cost + 2 * j, 'audit': best.audit || repeat('I', j), 'lines': best.lines || ins}}) as best
    from dp join (select conv_id, max(i) as n from seq group by 1) s on s.conv_id is not distinct from dp.conv_id and dp.i = s.n
    join way on way.p = dp.st where way.mid in (0, 3) group by 1),
say as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank,
    count(*) filter (again and not blank) as duplicate, count(*) filter (cut and not blank and not again) as truncated,
    count(*) filter (b || c not in ('su', 'ua', 'au')) as illegal from bad group by 1)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
    coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(best.cost, 0)::bigint as cost,
    coalesce(best.audit, '') as audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join say on say.conv_id is not distinct from o.conv_id left join fin on fin.conv_id is not distinct from o.conv_id
"""
