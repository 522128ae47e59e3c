"""Typed dashboard analytics on Spark DataFrames."""
