"""Shrinks text corpora to a token budget with Spark DataFrames."""
