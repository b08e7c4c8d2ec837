"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from chronolith.llm import bitsliced_search, collocations, exact_dedup, language_id, lexicon_bpe, license_rules, mincut_pages, mixing, rans_files, scaled_sketch, secrets_ledger, simhash, toxicity

QUERIES = {
    "op1_lexicon_bpe": lexicon_bpe.op1_lexicon_bpe,
    "op2_scaled_sketch": scaled_sketch.op2_scaled_sketch,
    "op3_language_id": language_id.op3_language_id,
    "op10_simhash_index": simhash.op10_simhash_index,
    "op4_curriculum_mix": mixing.op4_curriculum_mix,
    "op5_rans_files": rans_files.op5_rans_files,
    "op6_secret_ledger": secrets_ledger.op6_secret_ledger,
    "op7_toxic_segments": toxicity.op7_toxic_segments,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_license_rules": license_rules.op9_license_rules,
    "op11_collocation_tries": collocations.op11_collocation_tries,
    "op12_mincut_pages": mincut_pages.op12_mincut_pages,
    "op13_bitsliced_search": bitsliced_search.op13_bitsliced_search,
}
ORACLE_SQL = {
    "op4_curriculum_mix": mixing.ORACLE,
    "op6_secret_ledger": secrets_ledger.ORACLE,
    "op8_exact_dedup": exact_dedup.ORACLE,
    "op9_license_rules": license_rules.ORACLE,
    "op11_collocation_tries": collocations.ORACLE,
    "op13_bitsliced_search": bitsliced_search.ORACLE,
}
