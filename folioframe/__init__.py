"""Layout matching and table reconstruction over whole document corpora, on Spark DataFrames."""

__version__ = "0.1.0"
