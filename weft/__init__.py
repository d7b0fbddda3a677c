"""Interaction search and sparse regression on Spark DataFrames."""
