"""Operators over DataFrames: temporal features, joins, quality reports."""
