"""Column functions, and what ships this package to executors."""
