"""Windowed multi-node sensor analytics and training-data operators on Spark DataFrames."""
