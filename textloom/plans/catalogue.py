"""The queries of the engine and the SQL that says the same."""

from __future__ import annotations

from . import agent, annotation, models, retrieval

_BOOKS = [retrieval.book, annotation.book, agent.book, models.book]
QUERIES = {k: f for b in _BOOKS for k, f in b.queries.items()}
ORACLE_SQL = {k: s for b in _BOOKS for k, s in b.sql.items()}
