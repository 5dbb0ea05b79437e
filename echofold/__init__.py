"""echofold: exact-duplicate analytics over DataFrames, Spark first."""

__version__ = "0.1.0"
