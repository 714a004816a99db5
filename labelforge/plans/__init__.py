"""Registered queries, their DuckDB oracle SQL and the composite pipelines."""
