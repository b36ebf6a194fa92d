"""Query registry (``registry``), DuckDB oracle SQL (``oracle``) and checks."""
