"""sedimenta: a time-bucketed analytics engine on PySpark DataFrames and Spark SQL."""

__version__ = "0.1.0"
