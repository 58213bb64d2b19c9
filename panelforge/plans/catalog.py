"""Registry of the panel queries and their DuckDB SQL."""

from panelforge.plans import chain_queries, evaluation_queries, model_queries, robustness_queries, series_queries, study_queries

PARTS = (chain_queries, series_queries, evaluation_queries, model_queries, study_queries, robustness_queries)
QUERIES: dict = {k: v for p in PARTS for k, v in p.QUERIES.items()}
ORACLES: dict = {k: v for p in PARTS for k, v in p.ORACLES.items()}
