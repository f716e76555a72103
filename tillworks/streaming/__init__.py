"""Structured Streaming forms of the live jobs."""
