"""Cellarium: a PySpark-native analytics engine for product catalogues."""

__version__ = "0.1.0"
