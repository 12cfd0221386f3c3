"""Curation and evaluation of agent conversations, and preparation of training text, on Spark DataFrames."""
