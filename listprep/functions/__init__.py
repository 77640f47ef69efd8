"""Scalar column functions. All are built-in expressions; there is no Python code per row."""
