"""Queries of the training-data operators, by name, with their SQL where there is one."""

from __future__ import annotations

from importlib import import_module

_MODULES = {
    "op1_extract_html": "pages",
    "op2_top_k": "topk",
    "op3_media_columns": "archives",
    "op4_pack_documents": "packing",
    "op5_format_chats": "chat",
    "op6_judge_quality": "quality",
    "op7_near_duplicates": "neardup",
    "op8_mix_sources": "mixing",
    "op9_score_toxicity": "toxicity",
    "op10_remove_repeats": "repeats",
}


def _run(module: str):
    return lambda spark, sf_dir: import_module(f"{__package__}.{module}").query(spark, sf_dir)


def queries() -> dict:
    return {name: _run(module) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "SQL", None) for name, module in _MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
