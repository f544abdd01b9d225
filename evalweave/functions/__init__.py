"""Column expressions: no shuffles, no Python evaluation."""
