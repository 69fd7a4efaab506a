"""The registered queries of this package and their oracles."""

from codecorpus.llm import bottom_k, bpe, conversation_repair, decontaminate, license_scan, lm_scoring, quality_rules, secret_scan, simhash, substring_dedup, token_counts, url_filters, vector_codes

QUERIES = {
    "op1_decontaminate": decontaminate.query,
    "op2_lm_scoring": lm_scoring.query,
    "op3_substring_dedup": substring_dedup.query,
    "op4_url_filters": url_filters.query,
    "op5_simhash": simhash.query,
    "op6_token_counts": token_counts.query,
    "op7_secret_scan": secret_scan.query,
    "op8_bpe": bpe.query,
    "op9_license_scan": license_scan.query,
    "op10_quality_rules": quality_rules.query,
    "op11_bottom_k": bottom_k.query,
    "op12_conversation_repair": conversation_repair.query,
    "op13_vector_codes": vector_codes.query,
}
ORACLES = {
    "op4_url_filters": url_filters.ORACLE,
    "op12_conversation_repair": conversation_repair.ORACLE,
    "op13_vector_codes": vector_codes.ORACLE,
}
