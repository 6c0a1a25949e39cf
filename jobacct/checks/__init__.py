"""Derivation of accounting inputs from the shared test tables, and the
DuckDB oracle SQL that recomputes every registered query from the integers
behind those inputs (not from the rendered text)."""
