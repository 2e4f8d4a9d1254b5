"""Hazard, grid-cell and training-data analytics on Spark DataFrames."""
