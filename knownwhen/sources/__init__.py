"""Readers, text / nested ingestion, writers and manifests."""

from . import ingest, tables

__all__ = ["ingest", "tables"]
