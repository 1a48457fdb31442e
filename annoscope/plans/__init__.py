"""Plans: size checks, derived fixtures and the registered query catalog (with DuckDB oracles)."""
