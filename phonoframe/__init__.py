"""Pronunciation analytics on Spark DataFrames."""
