"""The queries of this folder and, where SQL can express one, the same in DuckDB's SQL."""

from __future__ import annotations

from . import fingerprint, maxent, minhash, mixing, packing, quality, shards, substring, topk, warc

QUERIES = {
    "op1_substring_dedup": substring.op1_substring_dedup,
    "op2_factorisation_machine": quality.op2_factorisation_machine,
    "op3_feistel_sharding": shards.op3_feistel_sharding,
    "op4_minhash_near_dedup": minhash.op4_minhash_near_dedup,
    "op5_exact_top_k": topk.op5_exact_top_k,
    "op6_maximum_entropy": maxent.op6_maximum_entropy,
    "op7_retrieval_packing": packing.op7_retrieval_packing,
    "op8_warc_revisits": warc.op8_warc_revisits,
    "op9_one_permutation": fingerprint.op9_one_permutation,
    "op10_block_mixing": mixing.op10_block_mixing,
}
ORACLES = {
    "op1_substring_dedup": substring.ORACLE,
    "op3_feistel_sharding": shards.ORACLE,
    "op4_minhash_near_dedup": minhash.ORACLE,
    "op5_exact_top_k": topk.ORACLE,
    "op8_warc_revisits": warc.ORACLE,
}
