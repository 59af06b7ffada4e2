"""The registered queries, by area."""

from . import analysis, collections, folds, formats, graphs, points, rounds, texts  # noqa: F401
