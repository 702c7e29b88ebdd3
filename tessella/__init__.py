"""Fractal image analytics on Spark DataFrames."""
