"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

#: Query, by the module that holds it.
NAMES = {
    "op1_retrieval_packing": "packing",
    "op2_audio_features": "audio",
    "op3_backoff_automaton": "lm",
    "op4_scaled_sketch": "scaled_sketch",
    "op5_simhash_near_dedup": "simhash",
    "op6_language_id": "langid",
    "op7_feistel_shards": "feistel",
    "op8_line_dedup": "line_dedup",
    "op9_kneser_ney_quality": "quality",
    "op10_byte_bpe": "bpe",
    "op11_fill_in_middle": "infill",
    "op12_spelling_variants": "variants",
    "op13_personal_data": "pii",
}


def queries() -> dict:
    out = {name: getattr(import_module(f"factloom.llm.{module}"), name) for name, module in NAMES.items()}
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for module in dict.fromkeys(NAMES.values()):
        out |= getattr(import_module(f"factloom.llm.{module}"), "ORACLE", {})
    return out
