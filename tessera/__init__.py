"""Tessera: oriented-box imagery analytics on Spark DataFrames."""
