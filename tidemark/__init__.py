"""Tidemark: ordered, keyed tables resolved from message logs, as PySpark DataFrames."""

__version__ = "0.1.0"
