"""Column expressions and Python functions for Spark."""
