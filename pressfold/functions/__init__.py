"""Column expressions and vectorised helpers."""
