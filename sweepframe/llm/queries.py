"""The numbered queries of this subpackage and their SQL checks."""

from __future__ import annotations

from . import exact, forest, langid, mergepath, mixing, packing, phrases, quality, resample, rtree, simhash, suffixes, tokencount

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_language_id": langid.op2_language_id,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_suffix_array": suffixes.op4_suffix_array,
    "op5_packing": packing.op5_packing,
    "op6_exact_dedup": exact.op6_exact_dedup,
    "op7_importance_resampling": resample.op7_importance_resampling,
    "op8_phrase_automata": phrases.op8_phrase_automata,
    "op9_token_counts": tokencount.op9_token_counts,
    "op10_mixing": mixing.op10_mixing,
    "op11_lsh_forest": forest.op11_lsh_forest,
    "op12_hard_negatives": rtree.op12_hard_negatives,
    "op13_token_alignment": mergepath.op13_token_alignment,
}
ORACLES = {
    "op4_suffix_array": suffixes.ORACLE,
    "op6_exact_dedup": exact.ORACLE,
    "op8_phrase_automata": phrases.ORACLE,
    "op10_mixing": mixing.ORACLE,
    "op12_hard_negatives": rtree.ORACLE,
}
