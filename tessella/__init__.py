"""Tessella: mask-layout analytics on Spark DataFrames."""
