"""All core queries and their SQL."""

from __future__ import annotations

from fumiyori.plans import entity_queries, problems, record_queries, relation_queries, text_queries

_MODULES = [problems, text_queries, relation_queries, entity_queries, record_queries]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
