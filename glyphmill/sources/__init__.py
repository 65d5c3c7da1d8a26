"""Readers: tokenizer folders, and texts as DataFrames."""
