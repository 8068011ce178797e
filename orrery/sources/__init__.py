"""Readers and writers: JSON, CSV, NumPy and N-Triples in; JSON, CSV, GraphML and DOT out."""
