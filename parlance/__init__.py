"""Spark jobs for building and judging synthetic dialogue data."""

__version__ = "0.1.0"
