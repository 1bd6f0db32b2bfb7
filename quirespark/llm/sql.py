"""DuckDB equivalents of those queries that SQL can express on whole tables."""

SQL: dict[str, str] = {}
