"""Summaries of semi-structured text as Spark DataFrames."""
