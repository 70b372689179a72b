"""URL analytics on Spark: URLs as struct columns, every operation a column function."""

__version__ = "0.1.0"
