"""Operators: each takes DataFrames and returns one lazy DataFrame."""
