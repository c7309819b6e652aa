"""Scalar functions: Column expressions, no Python on the executors."""
