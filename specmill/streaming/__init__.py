"""Incremental form of the batch job."""
