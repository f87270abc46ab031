"""Scalar and aggregate functions with strict SQL semantics, all as built-in expressions."""
