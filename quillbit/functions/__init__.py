"""Scalar functions: symbols, special functions, formatting."""
