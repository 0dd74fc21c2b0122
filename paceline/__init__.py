"""Paceline: Spark operators for building and evaluating code-speedup datasets."""

__version__ = "0.1.0"
