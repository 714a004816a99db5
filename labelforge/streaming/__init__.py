"""Structured Streaming use of the row-wise operators."""
