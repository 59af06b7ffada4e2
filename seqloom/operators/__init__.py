"""Operators on ordered collections, keyed collections, graphs, points and tables."""
