"""A Spark-native engine for curating measurement tables and text corpora."""

__version__ = "0.1.0"
