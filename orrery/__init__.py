"""Orrery: a PySpark-native engine for vectors, graphs, triples, text and tables."""

__version__ = "0.1.0"
