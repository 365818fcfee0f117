"""SentencePiece chunks, time-ordered encoding and conversation repair, against brute force, the library and SQL."""

import datetime
import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.llm import common as C
from lodestone.llm import conversations as V
from lodestone.llm import encoding as E
from lodestone.llm import pieces as P

SF = "/root/testdata/sf0.001"
NAMES = ("sale_lines", "sales", "items", "vendors", "clients", "conversations")


# -- pieces ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.vocabulary())


TEXTS = ["", " ", "   ", "a", " a", "a ", "  a  b  ", "a▁b", "▁", " ▁ ", "x" * 5000, "ab " * 3000, "a\nb\t c\r\n", "\x00z", "é　x <s> </s> <0x41>", "😀🧪 ok", "﷽ 𒀀", " nbsp", "word" + " " * 40 + "word", None]


def test_chunks_as_the_library(library):
    rng = random.Random(1)
    alphabet = [*"abcdeé ▁\n\t\x00.,!<>0😀中文", "  ", "the ", "▁▁▁", " " * 17]
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    for table in (P.Chunks(P.vocabulary()), P.Chunks(P.vocabulary(), most=50, longest=3)):
        for part in (texts[i : i + 100] for i in range(0, len(texts), 100)):
            ours = table.encode(part)
            assert ours == [table._bytes(library.encode(t or "")) for t in part]


def test_pieces_query(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    ours = {r.doc_id: r for r in P.op11_pieces(spark, SF).collect()}
    assert len(ours) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "")
        r = ours[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_pieces_edges(spark, library):
    rows = [(k, t, "mine", "other") for k, t in enumerate(TEXTS)] + [(1, "twice", "a", "b"), (1, "twice", "a", "b"), (None, "none", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string")
    out = P.decode(P.encode(df, P.vocabulary()), P.vocabulary()).collect()
    assert len(out) == len(rows) and sum(r.doc_id == 1 and r.text == "twice" for r in out) == 2
    for r in out:
        assert r.ids == library.encode(r.text or "") and r.decoded == library.decode(r.ids)
    assert P.encode(df.limit(0), P.vocabulary()).count() == 0
    odd = spark.createDataFrame([(1, None), (2, []), (3, [5, None, 264])], "k long, ids array<int>")
    assert {r.k: r.decoded for r in P.decode(odd, P.vocabulary()).collect()} == {1: "", 2: "", 3: library.decode([5, 264])}


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as M

    proto = M.ModelProto()
    with open(P.vocabulary(), "rb") as f:
        proto.ParseFromString(f.read())
    proto.pieces[500].piece = "a▁b"
    (tmp_path / "m.model").write_bytes(proto.SerializeToString())
    with pytest.raises(P.Crossing):
        P.Chunks(str(tmp_path / "m.model"))


# -- encoding --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def shop(duck):
    for t in NAMES:
        duck.execute(f"create or replace view {t} as select * from '{SF}/{t}.parquet'")
    return duck


def test_encoding_as_sql(shop, same):
    same(E.op12_encoding, E.SQL)


def brute(lines, sales, items, vendors, clients):
    """Histories by comparing every line with every other."""
    sold = {}
    for s, c, t in sales:
        if s is not None and t is not None and (s not in sold or (t, -1 if c is None else c) < sold[s]):
            sold[s] = (t, -1 if c is None else c)
    kind, nation, segment = ({k: v for k, v in t} for t in (items, vendors, clients))
    rows = []
    for s, i, v, flag in lines:
        if s in sold:
            i = -1 if i is None else i
            t, c = sold[s]
            rows.append({"sale": s, "t": t, "fold": zlib.crc32(str(s).encode()) % 5, "item": i, "vendor": v, "client": c, "kind": kind.get(i), "nation": nation.get(v), "segment": segment.get(c), "all": 0, "s": flag == "returned"})

    def past(r, column):
        own = [x["s"] for x in rows if x["t"] < r["t"] and x["fold"] != r["fold"] and x[column] == r[column]]
        return len(own), sum(own)

    def rate(n, s, p):
        return p if n < 1 else (1_000_000 * s + 50 * p) // (n + 50)

    out = {}
    for r in rows:
        top = rate(*past(r, "all"), 500_000)
        own = [r["sale"], r["item"], r["vendor"], sum(all(x[k] == r[k] for k in ("sale", "item", "vendor")) for x in rows), sum(x["s"] and all(x[k] == r[k] for k in ("sale", "item", "vendor")) for x in rows)]
        for column, above in (("item", "kind"), ("vendor", "nation"), ("client", "segment")):
            n, s = past(r, column)
            own += [n, rate(n, s, rate(*past(r, above), top))]
        out[tuple(own[:3])] = tuple(own)
    return sorted(out.values(), key=str)


@pytest.mark.parametrize("most", [3, 4096])
def test_encoding_brute_force(spark, most):
    """Ties of whole hours and of microseconds, hot keys, nulls, repeated lines and sales, unknown ids."""
    rng = random.Random(3)
    base = datetime.datetime(2024, 2, 29, 23, 59, 59, 999_990)
    when = lambda: base + rng.choice([datetime.timedelta(0), datetime.timedelta(microseconds=rng.randrange(12)), datetime.timedelta(milliseconds=rng.randrange(3)), datetime.timedelta(minutes=rng.randrange(130))])
    sales = [(s, rng.choice([None, 1, 1, 1, 2, 9]), None if s == 5 else when()) for s in range(60)]
    sales += [(7, 3, when()), (7, 3, sales[7][2]), sales[8], (None, 1, when())]
    lines = [(rng.choice([None, 0, 0, *range(64)]), rng.choice([None, 1, 1, 2, 3, 99]), rng.choice([None, 4, 4, 5, 77]), rng.choice(["returned", "kept", None])) for _ in range(300)]
    items, vendors, clients = [(1, "a"), (2, None), (3, "b")], [(4, 1), (5, None)], [(1, "x"), (2, None), (3, "x")]
    frames = [
        spark.createDataFrame(rows, schema).withColumn("n", F.lit("clash")).withColumn("fold", F.lit(None).cast("string"))
        for rows, schema in (
            (lines, "sale_id long, item_id long, vendor_id long, flag string"), (sales, "sale_id long, client_id long, sold_at timestamp_ntz"),
            (items, "item_id long, kind string"), (vendors, "vendor_id long, nation_id int"), (clients, "client_id long, segment string"),
        )
    ]
    ours = sorted((tuple(r) for r in E.encode(*frames, most=most).collect()), key=str)
    assert ours == brute(lines, sales, items, vendors, clients)
    if most == 3:
        return
    empty = [f.limit(0) for f in frames]
    assert E.encode(empty[0], *frames[1:], most=most).count() == 0 and E.encode(frames[0], empty[1], *frames[2:], most=most).count() == 0
    assert E.encode(*frames[:2], *empty[2:], most=most).count() == len(ours)


# -- conversations ---------------------------------------------------------------------------------


def cheapest(signature):
    """The least (cost, edits) over every sequence of edits, by search over all of bounded length."""
    rows = [divmod(V.LETTERS.index(c), 4) for c in signature]
    best = None
    # state machine of s?(ua)*, as text
    ok = lambda w: w == "" or (x := w[1:] if w[0] == "s" else w) and len(x) % 2 == 0 and x == "ua" * (len(x) // 2)

    def prefix(w):
        x = w[1:] if w[:1] == "s" else w
        return x == ("ua" * len(x))[: len(x)]

    def walk(k, w, cost, edits, left):
        nonlocal best
        if best is not None and cost > best[0] or not prefix(w):
            return
        if k == len(rows) and ok(w) and (best is None or (cost, edits) < best):
            best = (cost, edits)
        if left:
            for role in "ua":
                walk(k, w + role, cost + 2, edits + "I", left - 1)
        if k < len(rows):
            role, fault = rows[k]
            walk(k + 1, w, cost + 3, edits + "D", 3)
            if fault < 2:
                walk(k + 1, w + "suax"[role], cost + fault, edits + "K", 3)
                for to in "ua":
                    walk(k + 1, w + to, cost + fault + 2, edits + "R", 3)

    walk(0, "", 0, "", 3)
    return best


def test_trie_brute_force():
    rng = random.Random(5)
    found = {"".join(rng.choice(V.LETTERS) for _ in range(rng.randrange(1, 6))) for _ in range(400)}
    found |= {"".join(x) for x in itertools.product("aeimbf", repeat=2)} | {"eieiei", "eeiieeii", "m" * 6}
    trie = V.Trie()
    for signature in sorted(found):
        assert trie.answer(signature) == cheapest(signature), signature
    whole = V.Trie()
    for signature in rng.sample(sorted(found), len(found)):  # in any order the answers are the same
        assert whole.answer(signature) == cheapest(signature)
    assert len(trie.known) < 2000


def test_shared_prefixes_are_walked_once():
    trie, steps = V.Trie(), []
    step = trie.step
    trie.step = lambda layer, letter: steps.append(letter) or step(layer, letter)
    for signature in sorted(["eiei" * 50 + x for x in "abcdefghijklmnop"]):
        trie.answer(signature)
    assert len(steps) == 200 + 16
    long = V.Trie()
    assert long.answer("ei" * 50_000) == (0, "KK" * 50_000) and len(long.known) < 20


def test_conversations_as_sql(shop, same):
    same(V.op13_conversations, V.SQL)


def naive(rows):
    """Each conversation by itself."""
    talks = defaultdict(list)
    ids = {r[0] for r in rows}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 1:
            text = ""
        if k == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        if k == 4:
            role = "user"
        talks[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(k, 1)
    out = set()
    for conv in ids:
        own = sorted(talks[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        signature, seen, faults = "", set(), [0] * 4
        for _, role, text in own:
            strip = text.strip(" \t\n\x0b\x0c\r")
            fault = 2 if not strip else 3 if (role, text) in seen else 0 if strip[-1] in ".!?" else 1
            seen.add((role, text))
            faults[fault] += 1
            signature += V.LETTERS[4 * ("sua".find(role[0]) % 4 if role else 3) + fault]
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        first = [role[:1] for _, role, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(first))
        cost, audit = cheapest(signature)
        said, last, k = [], "", 0
        for edit in audit:
            to = "assistant" if last == "u" else "user"
            if edit == "I":
                said.append(f"{to}:")
            else:
                _, role, text = own[k]
                k += 1
                if edit == "D":
                    continue
                to = role if edit == "K" else to
                said.append(f"{to}:{text}")
            last = to[0]
        out.add((conv, gaps, faults[2], faults[3], faults[1], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("piece", [2, V.PIECE])
def test_conversations_edges(spark, piece, monkeypatch):
    """Nulls anywhere, tied turns, repeated rows, empty and odd roles, and conversations that lose all rows."""
    monkeypatch.setattr(V, "PIECE", piece)
    rng = random.Random(9)
    texts = [None, "", " \t\n", "Yes.", "Yes.", "No", "Why? ", "a\x0b", "Ünï!", "x" * 40 + "."]
    roles = ["user", "user", "assistant", "assistant", "system", None, "", "tool", "User", "s"]
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, -3, 0, 1, 1, 2, 3, 9]), rng.choice(roles), rng.choice(texts)) for _ in range(220)]
    lost = next(c for c in range(1000, 9000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    rows += [(lost, 1, "user", "Gone."), (lost, 1, "user", "Gone."), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"letters": F.lit(1), "audit": F.lit("x"), "digest": F.lit(None).cast("int")})
    ours = V.repair(df).collect()
    assert {tuple(r) for r in ours} == naive(rows) and len(ours) == len({r[0] for r in rows})
    assert next(tuple(r)[1:] for r in ours if r.conv_id == lost) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert V.repair(df.limit(0)).count() == 0


def test_a_long_conversation(spark):
    rows = spark.range(30_000).select(F.lit(1).alias("conv_id").cast("long"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.col("id").cast("string"), F.lit(".")).alias("text"), F.lit(1).alias("copies"))
    r = V.repair(rows, rows).first()
    said = "\n".join(f"{'user' if k % 2 == 0 else 'assistant'}:{k}." for k in range(30_000))
    assert (r.cost, r.audit, r.repaired_sha256) == (0, "K" * 30_000, hashlib.sha256(said.encode()).hexdigest())
