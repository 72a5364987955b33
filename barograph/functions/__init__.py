"""Column-level functions: scalars, dates, text, statistics."""
