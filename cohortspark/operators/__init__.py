"""Operator library: every function maps DataFrames to a lazy DataFrame."""
