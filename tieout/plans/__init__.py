"""Whole processes put together from the operators."""
