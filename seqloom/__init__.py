"""Ordered collections, graphs, text and numbers on Spark DataFrames."""
