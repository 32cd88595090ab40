"""The queries of this subpackage by name, and the SQL that states their rows where SQL can."""

from __future__ import annotations

from . import divergence, license_scan, mixing, near_dups, packing, pii, quality_classifier, quality_rules, suffix_dedup, token_counts, topk_search, warc, whitening

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_quality_classifier": quality_classifier.op4_quality_classifier,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_warc": warc.op6_warc,
    "op7_topk_search": topk_search.op7_topk_search,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_near_dups": near_dups.op9_near_dups,
    "op10_mixing": mixing.op10_mixing,
    "op11_divergence": divergence.op11_divergence,
    "op12_whitening": whitening.op12_whitening,
    "op13_suffix_dedup": suffix_dedup.op13_suffix_dedup,
}

ORACLES = {
    "op6_warc": warc.ORACLE_SQL,
    "op7_topk_search": topk_search.ORACLE_SQL,
    "op9_near_dups": near_dups.ORACLE_SQL,
    "op10_mixing": mixing.ORACLE_SQL,
    "op11_divergence": divergence.ORACLE_SQL,
}
