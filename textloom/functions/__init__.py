"""Column expressions for vectors and text."""
