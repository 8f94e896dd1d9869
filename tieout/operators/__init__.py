"""Operators over whole tables. Each takes DataFrames and returns DataFrames or small reports."""
