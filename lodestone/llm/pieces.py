"""SentencePiece encoding and decoding with a table of distinct chunks.

The model's text is the text with a marker in front and markers for its spaces. Where no piece has a marker after
another character, no merge reaches from a character into a marker after it: a run of markers with the word behind it
(a chunk) is segmented alike wherever it stands. Each batch of texts is cut into chunks, the distinct ones that the
table lacks are segmented once, by the library, and the ids are joined back by the chunks' positions. A task's table
goes on to the worker's next tasks and is bounded: of the chunks that were met, the last ``most`` and as many before
them stay. Chunks are joined where they stand, so no occurrence of a word is exchanged: a plan that sends each
(document, position, chunk) to a global table and back moves several times the corpus.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Fixed value: the library's sign for a space.
MARKER = "▁"


class Crossing(ValueError):
    """A piece of the model spans a word's end and the marker after it, or markers are not put as chunks need them."""


class Chunks:
    """Ids of texts, exactly as the library gives them for whole texts, and texts of ids."""

    def __init__(self, path: str, most: int = 150_000, longest: int = 64):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as M

        with open(path, "rb") as f:
            model = f.read()
        proto = M.ModelProto()
        proto.ParseFromString(model)
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec, kinds = proto.normalizer_spec, {p.type for p in proto.pieces}
        cross = any(re.search(f"[^{MARKER}]{MARKER}", p.piece) for p in proto.pieces)
        other = spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix
        if cross or other or M.ModelProto.SentencePiece.USER_DEFINED in kinds or proto.trainer_spec.model_type != M.TrainerSpec.BPE:
            raise Crossing(path)
        self.most, self.longest = most, longest
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.cut = re.compile(" +[^ ]*").findall
        self.alone = self._bytes([self.sp.piece_to_id(MARKER)])

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return np.array(ids, "<i4").tobytes()

    def _segment(self, chunks: list[str]) -> dict[str, bytes]:
        """Each chunk alone; the library puts the first marker itself, but for a text of nothing else."""
        ids = self.sp.encode([c[1:] for c in chunks], num_threads=1)
        return {c: self._bytes(i) if len(c) > 1 else self.alone for c, i in zip(chunks, ids, strict=True)}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text; null is empty, and an empty text has none."""
        cut = [self.cut(" " + t.replace(MARKER, " ")) if t else () for t in texts]
        known = self.young
        lacking = [c for c in set().union(*cut) if c not in known] if cut else []
        if lacking:
            known.update((c, self.old[c]) for c in lacking if c in self.old)
            known.update(self._segment([c for c in lacking if c not in known]))
        out = [b"".join(map(known.__getitem__, chunks)) for chunks in cut]
        for c in lacking:
            if len(c) > self.longest:
                del known[c]
        if len(known) > self.most:
            self.old, self.young = known, {}
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.sp.decode(ids) if ids else []


def chunks_of(path: str) -> Chunks:
    """A worker's table, which goes on from one task to the next."""
    return C.kept(Chunks, path)


#: Ids that are decoded at once.
DECODE_IDS = 1 << 18


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text`` as a column ``ids`` (array<int>), which replaces one of that name.

    No begin or end ids. A null or empty text has an empty array; whole texts are encoded, however long. Each row has a
    row, repeated ones too; an empty table gives none. Other columns stay as they are. Ties do not arise.
    """
    C.text_batches(docs.sparkSession)
    source = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != ids), F.col(f"`{text}`").cast("string").alias(C.unused("__text", docs.columns)))
    schema = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != ids)).withColumn(ids, F.lit(None).cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunks_of(path)
        for batch in batches:
            found = table.encode(batch.column(batch.num_columns - 1).to_pylist())
            ends = np.cumsum([0, *(len(b) // 4 for b in found)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4")))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], [*batch.schema.names[:-1], ids])

    return source.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the text of the token ids in ``ids`` as a column ``text``, which replaces one of that name.

    Null or no ids give an empty text; null ids in an array are left out. Each row has a row, and other columns stay.
    """
    C.text_batches(rows.sparkSession)
    source = rows.select(*(F.col(f"`{c}`") for c in rows.columns if c != text), F.col(f"`{ids}`").cast("array<int>").alias(C.unused("__ids", rows.columns)))
    schema = rows.select(*(F.col(f"`{c}`") for c in rows.columns if c != text)).withColumn(text, F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunks_of(path)
        for batch in batches:
            column, found = batch.column(batch.num_columns - 1), []
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_pylist()
            for s, e in C.slices(sizes, DECODE_IDS):
                part = column.slice(s, e - s)
                values = part.flatten()
                if values.null_count:
                    lists = [[i for i in x or () if i is not None] for x in part.to_pylist()]
                else:
                    ids_of, ends = values.to_numpy().tolist(), np.cumsum([0, *sizes[s:e]]).tolist()
                    lists = [ids_of[a:b] for a, b in itertools.pairwise(ends)]
                found += table.decode(lists)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string())], [*batch.schema.names[:-1], text])

    return source.mapInArrow(run, schema)


def vocabulary() -> str:
    """The model's file."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and what they decode to, as digests."""
    path = vocabulary()
    docs = C.table(spark, sf_dir, "documents").select(C.whole("doc_id"), "text")
    out = decode(encode(docs, path).select("doc_id", "ids"), path)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
