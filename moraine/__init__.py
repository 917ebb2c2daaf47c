"""moraine: a PySpark-native engine for building and querying a multi-source knowledge base."""

__version__ = "0.1.0"
