"""Column expressions: keys, casts, scaling and error metrics."""
