"""The queries of this subpackage and their SQL twins."""

from factlake.llm import byte_bpe, divergence, exact_dedup, language_id, mixing, near_dedup, quality, substring_dedup, suffix_dedup, token_counts, vector_search, warc, whitening

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_nearest_neighbours": vector_search.op4_nearest_neighbours,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_byte_bpe": byte_bpe.op6_byte_bpe,
    "op7_quality": quality.op7_quality,
    "op8_warc": warc.op8_warc,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_language_id": language_id.op10_language_id,
    "op11_divergence_audit": divergence.op11_divergence_audit,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_substring_dedup": substring_dedup.op13_substring_dedup,
}
ORACLE_SQL = {
    "op3_exact_dedup": exact_dedup.ORACLE_SQL,
    "op8_warc": warc.ORACLE_SQL,
    "op9_near_dedup": near_dedup.ORACLE_SQL,
    "op11_divergence_audit": divergence.ORACLE_SQL,
    "op13_substring_dedup": substring_dedup.ORACLE_SQL,
}
