"""Spark-native analytics over source code and text held as tables of byte-exact spans."""

__version__ = "0.1.0"
