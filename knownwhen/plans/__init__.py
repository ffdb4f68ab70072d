"""Metadata that drives computation: aggregation plans, publication rules, gates, windows."""
