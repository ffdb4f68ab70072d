"""Structured Streaming versions of operators whose inputs arrive live."""
