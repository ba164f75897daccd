"""lorefold: event-sourced knowledge processing on Spark DataFrames."""

__version__ = "0.1.0"
