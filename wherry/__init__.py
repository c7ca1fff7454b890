"""Spark-native analytics over a vault of linked notes: search, graph, schema, usage and data preparation."""

__version__ = "0.1.0"
