"""Corpus jobs over paged documents, as Spark DataFrames."""
