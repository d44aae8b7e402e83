"""Bispectral analytics for space-time fields on Spark DataFrames."""

__version__ = "0.1.0"
