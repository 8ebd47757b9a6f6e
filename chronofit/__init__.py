"""Coincidence-timing analytics on Spark DataFrames."""
