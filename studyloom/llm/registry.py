"""Registered queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

from . import chat_format, decontaminate, divergence, fill_in_middle, jaccard_join, line_crf, line_dedup, quality_rules, source_mix, substring_dedup, token_count, toxicity, warc_audit

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_token_counts": token_count.op3_token_counts,
    "op4_warc_audit": warc_audit.op4_warc_audit,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_source_mix": source_mix.op6_source_mix,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_chat_format": chat_format.op10_chat_format,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_quality_classifier": line_crf.op12_quality_classifier,
    "op13_fill_in_middle": fill_in_middle.op13_fill_in_middle,
}
SQL = {
    "op1_substring_dedup": substring_dedup.SQL,
    "op2_decontaminate": decontaminate.SQL,
    "op4_warc_audit": warc_audit.SQL,
    "op9_jaccard_join": jaccard_join.SQL,
    "op10_chat_format": chat_format.SQL,
    "op11_source_divergence": divergence.SQL,
    "op13_fill_in_middle": fill_in_middle.SQL,
}
