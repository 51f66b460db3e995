"""DuckDB statements the query results are checked against."""
