"""Names of the engine's queries and their SQL counterparts."""

from __future__ import annotations

from brindle.plans import adjudication, extraction, matching, memory, ops, projection, relational, rules, search, state

_MODULES = (relational, search, state, rules, memory, ops, matching, extraction, adjudication, projection)
QUERIES: dict = {name: f for module in _MODULES for name, f in module.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
