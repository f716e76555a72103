"""Schemas, table adapters, payload readers and sinks."""
