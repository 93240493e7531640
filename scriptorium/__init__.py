"""A document knowledge-base engine on Spark DataFrames."""

__version__ = "0.1.0"
