"""Operators on whole DataFrames that the analyses share."""
