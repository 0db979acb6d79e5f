"""Operators: DataFrame in, DataFrame out (or a dict of them)."""
