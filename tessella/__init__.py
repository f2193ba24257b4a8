"""Tessella: corpus-construction analytics on Spark DataFrames."""
