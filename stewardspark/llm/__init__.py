"""Operators of a training-data pipeline, each with a registered query.

Nothing else in the library imports this subpackage.
"""
