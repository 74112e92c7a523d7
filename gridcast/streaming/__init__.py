"""Structured Streaming forms of the resampling operators."""
