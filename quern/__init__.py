"""Full-text search and ranking on Spark DataFrames."""

__version__ = "0.1.0"
