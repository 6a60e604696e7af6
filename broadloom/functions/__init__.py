"""Column functions: each takes columns and returns a column."""
