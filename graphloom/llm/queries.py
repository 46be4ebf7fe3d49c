"""The queries of the corpus operators, by name, and SQL for those that it can express."""

from __future__ import annotations

from graphloom.llm import chat, divergence, exact_dedup, interval_join, jaccard_join, language_id, mixing, packing, quality_classifier, quality_rules, substring_dedup, url_filters, warc

QUERIES = {
    "op1_mix": mixing.op1_mix,
    "op2_perspectives": chat.op2_perspectives,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_warc": warc.op4_warc,
    "op5_packing": packing.op5_packing,
    "op6_jaccard_join": jaccard_join.op6_jaccard_join,
    "op7_language_id": language_id.op7_language_id,
    "op8_quality": quality_classifier.op8_quality,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_url_filters": url_filters.op11_url_filters,
    "op12_divergence": divergence.op12_divergence,
    "op13_interval_join": interval_join.op13_interval_join,
}
ORACLE_SQL = {"op1_mix": mixing.SQL, "op2_perspectives": chat.SQL, "op4_warc": warc.SQL, "op9_exact_dedup": exact_dedup.SQL, "op12_divergence": divergence.SQL, "op13_interval_join": interval_join.SQL}
