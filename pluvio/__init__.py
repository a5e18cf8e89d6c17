"""pluvio: extreme-value and dependence analysis on Spark DataFrames."""

__version__ = "0.1.0"
