"""The operators' queries over the driver's tables, with their SQL."""

from __future__ import annotations

from . import chosen, cross, exports, facts, facts2, formats, history, more, rank_gate, replay, reports, rest, settings, stats, tokens, validation

MODULES = (rank_gate, facts, facts2, cross, exports, history, replay, validation, stats, tokens, formats, more, settings, chosen, reports, rest)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
