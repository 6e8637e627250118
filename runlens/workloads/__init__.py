"""The registered queries and their DuckDB oracles."""
