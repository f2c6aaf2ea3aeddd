"""The queries over the shared tables, gathered from the modules that define them."""

from __future__ import annotations

from . import asked, conditions, facts, graph, lifecycle, more, search, texts

MODULES = (facts, conditions, graph, lifecycle, search, texts, more, asked)
QUERIES: dict = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
