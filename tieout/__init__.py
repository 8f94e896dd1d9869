"""Checking and reproducing recurring tabular processes with Spark DataFrames."""

__version__ = "0.1.0"
