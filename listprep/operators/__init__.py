"""Operators on record tables: DataFrame in, DataFrame out."""
