"""Spectrum analytics and corpus preparation on Spark DataFrames."""
