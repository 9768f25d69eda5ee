"""All queries of the core and their SQL."""

from __future__ import annotations

from . import graph_queries, hierarchy_queries, operator_queries, retrieval_queries

_MODULES = (retrieval_queries, graph_queries, operator_queries, hierarchy_queries)

QUERIES: dict = {}
ORACLES: dict = {}
for _m in _MODULES:
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
