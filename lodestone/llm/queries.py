"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import chunks, conversations, decontaminate, embeddings, encoding, extract, licenses, minhash, packing, pieces, reshard, suffixes, toxicity

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_resharding": reshard.op3_resharding,
    "op4_extraction": extract.op4_extraction,
    "op5_packing": packing.op5_packing,
    "op6_substring": chunks.op6_substring,
    "op7_embeddings": embeddings.op7_embeddings,
    "op8_minhash": minhash.op8_minhash,
    "op9_suffixes": suffixes.op9_suffixes,
    "op10_licenses": licenses.op10_licenses,
    "op11_pieces": pieces.op11_pieces,
    "op12_encoding": encoding.op12_encoding,
    "op13_conversations": conversations.op13_conversations,
}

ORACLE_SQL = {
    "op1_decontamination": decontaminate.SQL,
    "op7_embeddings": embeddings.SQL,
    "op8_minhash": minhash.SQL,
    "op10_licenses": licenses.sql(),
    "op12_encoding": encoding.SQL,
    "op13_conversations": conversations.SQL,
}
