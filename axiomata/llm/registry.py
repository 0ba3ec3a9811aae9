"""The queries of this package and their oracles."""

from axiomata.llm import collision_search, language_id, lm_scoring, near_dedup, packing, piece_lattice, quality_rules, repeat_index, sanitise, url_filters

QUERIES = {
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "rule_ablations": quality_rules.rule_ablations,
    "op1_repeat_index": repeat_index.op1_repeat_index,
    "op2_lm_scoring": lm_scoring.op2_lm_scoring,
    "op3_sanitise": sanitise.op3_sanitise,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_packing": packing.op5_packing,
    "op6_language_id": language_id.op6_language_id,
    "op7_piece_lattice": piece_lattice.op7_piece_lattice,
    "op9_collision_search": collision_search.op9_collision_search,
    "op10_url_filters": url_filters.op10_url_filters,
}
ORACLES = {
    "op8_quality_rules": quality_rules.ORACLE,
    "rule_ablations": quality_rules.ABLATIONS_ORACLE,
    "op10_url_filters": url_filters.ORACLE,
}
