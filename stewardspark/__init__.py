"""Governance analytics for AI-assisted software development, on Spark."""
