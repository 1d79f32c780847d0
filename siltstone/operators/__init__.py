"""Operators over findings: DataFrame in, DataFrame out."""
