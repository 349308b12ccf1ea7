"""Every registered query of the library with the SQL it is held against."""

from __future__ import annotations

from riskgraph.plans import feature_queries, graph_queries, model_queries, report_queries, risk_queries

MODULES = (feature_queries, graph_queries, risk_queries, model_queries, report_queries)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
