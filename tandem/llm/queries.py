"""The queries of the subpackage and their SQL."""

from __future__ import annotations

from . import bpe, decontaminate, divergence, fuzzy_lines, lexical, mixing, ngram_join, passages, quality, rules, suffixes, toxicity, warc

QUERIES = {
    "op1_compression_quality": quality.query,
    "op2_arc_to_warc": warc.query,
    "op3_threshold_rules": rules.query,
    "op4_suffix_dedup": suffixes.query,
    "op5_fuzzy_lines": fuzzy_lines.query,
    "op6_winnow_decontaminate": decontaminate.query,
    "op7_ngram_jaccard": ngram_join.query,
    "op8_mix_sources": mixing.query,
    "op9_toxicity_nbsvm": toxicity.query,
    "op10_substring_dedup": passages.query,
    "op11_stratified_search": lexical.query,
    "op12_byte_bpe": bpe.query,
    "op13_source_divergence": divergence.query,
}

ORACLES = {
    "op10_substring_dedup": passages.ORACLE,
    "op11_stratified_search": lexical.ORACLE,
    "op13_source_divergence": divergence.ORACLE,
    "op2_arc_to_warc": warc.ORACLE,
    "op3_threshold_rules": rules.ORACLE,
    "op6_winnow_decontaminate": decontaminate.ORACLE,
    "op8_mix_sources": mixing.ORACLE,
}
