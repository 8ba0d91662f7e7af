"""Queries of this folder and their SQL, where SQL can express them."""

from __future__ import annotations

from timedtext.llm import (
    chat,
    collocations,
    decontaminate,
    language,
    licenses,
    line_dedup,
    near_dup,
    ngram_join,
    packing,
    quality,
    suffix_dedup,
    url_rules,
    whitening,
)

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_packing": packing.op3_packing,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_url_rules": url_rules.op6_url_rules,
    "op7_near_dup": near_dup.op7_near_dup,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_language_id": language.op9_language_id,
    "op10_chat_formatting": chat.op10_chat_formatting,
    "op11_ngram_jaccard": ngram_join.op11_ngram_jaccard,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_phrase_collocations": collocations.op13_phrase_collocations,
}

# The others have no SQL form; tests/llm compares them with plain versions.
ORACLES = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op4_decontaminate": decontaminate.ORACLE,
    "op7_near_dup": near_dup.ORACLE,
    "op8_quality_rules": quality.ORACLE,
    "op10_chat_formatting": chat.ORACLE,
    "op11_ngram_jaccard": ngram_join.ORACLE,
    "op13_phrase_collocations": collocations.ORACLE,
}
