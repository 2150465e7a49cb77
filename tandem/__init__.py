"""Paired-measurement coupling statistics on Spark DataFrames."""
