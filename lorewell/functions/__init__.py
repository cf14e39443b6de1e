"""Scalar functions: every one is a built-in Column expression."""
