"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from meritlens.llm import align, bpe, chat, exact, langid, lines, merkle, minhash, mixing, shards, toxicity, vectors, warc
from meritlens.llm.common import table

QUERIES = {
    "op1_minhash_dedup": lambda s, d: minhash.op1_minhash_dedup(table(s, d, "documents")),
    "op2_language": lambda s, d: langid.op2_language(table(s, d, "documents")),
    "op3_exact_dedup": lambda s, d: exact.op3_exact_dedup(table(s, d, "documents")),
    "op4_warc": lambda s, d: warc.op4_warc(table(s, d, "pages")),
    "op5_toxicity": lambda s, d: toxicity.op5_toxicity(table(s, d, "documents"), table(s, d, "labels")),
    "op6_embedding_dedup": lambda s, d: vectors.op6_embedding_dedup(table(s, d, "embeddings")),
    "op7_source_mixing": lambda s, d: mixing.op7_source_mixing(table(s, d, "documents")),
    "op8_sharding": lambda s, d: shards.op8_sharding(table(s, d, "documents")),
    "op9_line_dedup": lambda s, d: lines.op9_line_dedup(table(s, d, "documents")),
    "op10_bpe": lambda s, d: bpe.op10_bpe(table(s, d, "documents")),
    "op11_merkle_manifest": lambda s, d: merkle.op11_merkle_manifest(table(s, d, "documents")),
    "op12_chat_format": lambda s, d: chat.op12_chat_format(table(s, d, "conversations")),
    "op13_token_alignment": lambda s, d: align.op13_token_alignment(table(s, d, "documents")),
}
ORACLES = {
    "op6_embedding_dedup": vectors.OP6_SQL,
    "op1_minhash_dedup": minhash.OP1_SQL,
    "op3_exact_dedup": exact.OP3_SQL,
    "op4_warc": warc.OP4_SQL,
    "op11_merkle_manifest": merkle.OP11_SQL,
}
