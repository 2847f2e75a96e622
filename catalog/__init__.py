"""Registered queries: every entry pairs a Spark plan with an independent DuckDB formulation."""
