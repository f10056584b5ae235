"""All queries of the core package."""

from __future__ import annotations

from graphmill.plans import code_extract, code_graph, code_lookup, golden, ledger, reference_integrity, search, task_trees

_MODULES = [reference_integrity, task_trees, ledger, code_lookup, search, code_graph, code_extract, golden]
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
