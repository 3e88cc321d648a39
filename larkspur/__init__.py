"""larkspur: a Spark-native, read-only engine for relational tables."""

__version__ = "0.1.0"
