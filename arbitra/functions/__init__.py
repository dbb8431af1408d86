"""Column functions: no joins, no shuffles, no Python on the executors."""
