"""Query catalog: Spark plans per operator and their DuckDB oracle SQL."""
