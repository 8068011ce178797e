"""Operators over DataFrames: joins, top-k, fusion, graphs, aggregation."""
