"""Regression, diagnostics and descriptive statistics on Spark DataFrames."""
