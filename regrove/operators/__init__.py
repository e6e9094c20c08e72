"""Estimation operators over DataFrames."""
