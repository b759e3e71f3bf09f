"""Registered queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from . import ann_tree, bpe_codec, chat_format, fingerprints, line_dedup, lm_scoring, mixing, prefix_trie, quality_classifier, quality_rules, simhash, toxicity, whitening

QUERIES = {
    "op1_lm_score": lm_scoring.op1_lm_score,
    "op2_bpe": bpe_codec.op2_bpe,
    "op3_fingerprint": fingerprints.op3_fingerprint,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_quality": quality_classifier.op7_quality,
    "op8_mix": mixing.op8_mix,
    "op9_chat": chat_format.op9_chat,
    "op10_simhash": simhash.op10_simhash,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_ann": ann_tree.op12_ann,
    "op13_whitening": whitening.op13_whitening,
}
ORACLES = {
    "op4_line_dedup": line_dedup.ORACLE,
    "op8_mix": mixing.ORACLE,
    "op9_chat": chat_format.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
}
