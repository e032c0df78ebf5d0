"""tessella: a columnar analytics engine expressed entirely as Spark DataFrames."""

__version__ = "0.1.0"
