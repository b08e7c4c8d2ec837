"""Versioned entity state over an ordered timeline, on Spark DataFrames."""
