"""The queries of this subpackage, and the DuckDB SQL of those that SQL can express over whole tables."""

from __future__ import annotations

from . import chat, decontam, hardneg, langid, linededup, neardup, quality, rulefit, sampling, substring, tokencount, urls, whitening

QUERIES = {
    "op1_line_dedup": linededup.op1_line_dedup,
    "op2_chat_formatting": chat.op2_chat_formatting,
    "op3_url_filter": urls.op3_url_filter,
    "op4_language_id": langid.op4_language_id,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_decontamination": decontam.op6_decontamination,
    "op7_sentencepiece": sampling.op7_sentencepiece,
    "op8_quality_classifier": rulefit.op8_quality_classifier,
    "op9_minhash_neardup": neardup.op9_minhash_neardup,
    "op10_token_counts": tokencount.op10_token_counts,
    "op11_hard_negatives": hardneg.op11_hard_negatives,
    "op12_substring_dedup": substring.op12_substring_dedup,
    "op13_whitening": whitening.op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op2_chat_formatting": chat.OP2_SQL,
    "op11_hard_negatives": hardneg.OP11_SQL,
}
