"""Queries of this subpackage, one module each."""

from __future__ import annotations

from voxframe.llm import q_extraction, q_linededup, q_media, q_mixing, q_neardup, q_packing, q_quality, q_quoting, q_secrets, q_substrings

MODULES = (q_quality, q_mixing, q_packing, q_media, q_secrets, q_extraction, q_linededup, q_neardup, q_substrings, q_quoting)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
