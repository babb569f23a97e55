"""Leakage-free evaluation of classifiers on tables, written as Spark jobs."""

from foldwise.frame import Frame, col

__all__ = ["Frame", "col"]
