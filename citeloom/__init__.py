"""citeloom: attribution analytics and text-data operators on Spark DataFrames."""

__version__ = "0.1.0"
