"""The engine's queries over the driver tables, and SQL of the same results."""

from __future__ import annotations

from notegrove.plans import queries_notes, queries_store, queries_text

QUERIES: dict = queries_text.QUERIES | queries_store.QUERIES | queries_notes.QUERIES
ORACLE_SQL: dict[str, str] = queries_text.SQL | queries_store.SQL | queries_notes.SQL
