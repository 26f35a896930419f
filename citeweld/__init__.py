"""Record linkage for bibliographic references on Spark DataFrames."""

__version__ = "0.1.0"
