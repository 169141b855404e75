"""Registered queries, their DuckDB oracles, staging helpers, jobs and developer tools."""
