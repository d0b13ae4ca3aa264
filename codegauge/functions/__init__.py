"""Column expressions: each takes columns and returns a column, no shuffle, no Python rows."""
