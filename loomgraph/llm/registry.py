"""Queries of this subpackage, for the entry point."""

from __future__ import annotations

import corpus_pipeline

from . import chat, decontaminate, language, line_dedup, lm_score, multiset_hash, near_dedup, packing, quality, substring_dedup

_QUERIES = {
    "op1_chat_format": (chat.query, chat.SQL),
    "op2_fingerprints": (multiset_hash.query, None),
    "op3_packing": (packing.query, None),
    "op4_language_id": (language.query, None),
    "op5_lm_score": (lm_score.query, None),
    "op6_decontaminate": (decontaminate.query, None),
    "op7_quality": (quality.query, None),
    "op8_near_dedup": (near_dedup.query, None),
    "op9_substring_dedup": (substring_dedup.query, None),
    "op10_line_dedup": (line_dedup.query, line_dedup.SQL),
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}


def queries() -> dict:
    return {name: f for name, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}
