"""Operators over DataFrames: index, search, statistics, store."""
