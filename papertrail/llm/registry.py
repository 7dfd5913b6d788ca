"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from papertrail.llm import (
    best_fit, counts, fingerprint, leaks, ngram_trie, packing, periodic, quality, records, secret_scan, similar, toxicity, vector_codes)

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_ngram_jaccard": similar.op2_ngram_jaccard,
    "op3_benchmark_leaks": leaks.op3_benchmark_leaks,
    "op4_lm_score": ngram_trie.op4_lm_score,
    "op5_token_counts": counts.op5_token_counts,
    "op6_token_records": records.op6_token_records,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_lexical_packing": packing.op8_lexical_packing,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_order_minhash": fingerprint.op10_order_minhash,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_best_fit": best_fit.op12_best_fit,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard": similar.SQL, "op3_benchmark_leaks": leaks.SQL,
            "op13_vector_codes": vector_codes.SQL}
