"""Checks of the reports against DuckDB on the test tables."""
