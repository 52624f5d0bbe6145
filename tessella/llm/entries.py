"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tessella.llm import audio, language_id, mixing, packing, quality_rules, seed_extend, signature_trees, sstable, suffix_dedup, tree_weighting

QUERIES = {
    "op1_audio_features": audio.query,
    "op2_suffix_dedup": suffix_dedup.query,
    "op3_pack_sequences": packing.query,
    "op4_signature_tree_join": signature_trees.query,
    "op5_seed_extend_dedup": seed_extend.query,
    "op6_quality_rules": quality_rules.query,
    "op7_hierarchical_mixing": mixing.query,
    "op8_language_id": language_id.query,
    "op9_sstable_tokens": sstable.query,
    "op10_tree_weighting": tree_weighting.query,
}

ORACLE_SQL: dict[str, str] = {
    "op4_signature_tree_join": signature_trees.ORACLE_SQL,
    "op5_seed_extend_dedup": seed_extend.ORACLE_SQL,
    "op7_hierarchical_mixing": mixing.ORACLE_SQL,
}
