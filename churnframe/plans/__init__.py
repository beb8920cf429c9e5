"""Registered queries (catalog, exact, trained) and the DuckDB oracle SQL."""
