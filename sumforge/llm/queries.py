"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from sumforge.llm import bpe_codec, conversation_repair, exact_dedup, fingerprints, minhash, packing, prefix_trie, quality, sharding, site_templates, substring_dedup, suffix_dedup, token_counts

QUERIES = {
    "op1_fingerprints": fingerprints.op1,
    "op2_substring_dedup": substring_dedup.op2,
    "op3_packing": packing.op3,
    "op4_suffix_dedup": suffix_dedup.op4,
    "op5_token_counts": token_counts.op5,
    "op6_sharding": sharding.op6,
    "op7_minhash": minhash.op7,
    "op8_exact_dedup": exact_dedup.op8,
    "op9_quality": quality.op9,
    "op10_bpe_codec": bpe_codec.op10,
    "op11_site_templates": site_templates.op11,
    "op12_prefix_trie": prefix_trie.op12,
    "op13_conversation_repair": conversation_repair.op13,
}

ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": substring_dedup.ORACLE_SQL,
    "op8_exact_dedup": exact_dedup.ORACLE_SQL,
    "op12_prefix_trie": prefix_trie.ORACLE_SQL,
    "op13_conversation_repair": conversation_repair.ORACLE_SQL,
}
