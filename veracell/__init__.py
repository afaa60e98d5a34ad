"""Tabular error detection, profiling and data preparation on Spark DataFrames."""
