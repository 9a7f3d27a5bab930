"""Ingest of new violations, in batch and as a stream."""
