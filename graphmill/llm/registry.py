"""All queries of this subpackage."""

from __future__ import annotations

from graphmill.llm import docpairs, leakage, packing, provenance, similar, splitting, syntax, truncation

_MODULES = [docpairs, similar, syntax, provenance, packing, leakage, splitting, truncation]
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
