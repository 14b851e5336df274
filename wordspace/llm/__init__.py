"""Operators for preparing training data of language models, on Spark DataFrames."""
