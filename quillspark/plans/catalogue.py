"""Every registered query of the library and its oracle SQL."""

from __future__ import annotations

from . import candidate_queries, context_queries, fusion_queries, graph_queries, learning_queries, persona_queries, place_queries, recommend_queries, relational_queries, retrieval_queries, rule_queries, search_queries, state_queries, text_queries, twin_queries, world_queries  # noqa: F401
from .register import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
