"""The registered queries over the given tables, and their SQL."""

from __future__ import annotations

from tidemill.plans import columns, events, files, numbers, rules, social, texts

_MODULES = (columns, events, numbers, rules, texts, social, files)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
