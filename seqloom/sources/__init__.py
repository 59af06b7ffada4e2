"""Readers, writers and generators of graphs, sequences and tables."""
