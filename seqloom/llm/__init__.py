"""Operators for preparing training text at scale.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its queries
only where it is present.
"""
