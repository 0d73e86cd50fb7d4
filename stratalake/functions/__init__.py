"""Scalar transformations as Column expressions; no Python runs on the executors."""
