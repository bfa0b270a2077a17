"""Placing short, uncertain pieces of text in a large corpus, on PySpark DataFrames."""
