"""List preparation for customer and vehicle records on Spark DataFrames."""

__version__ = "0.1.0"
