"""Registered queries: each pairs a Spark plan with the SQL text that checks it."""

from __future__ import annotations

from importlib import import_module

from .registry import ORACLES, QUERIES

MODULES = ("grids", "shaping", "asof", "joins", "bids", "aggregates", "sequences", "sources", "quality", "evaluation",
           "statistics", "policies", "sets", "streams", "resampled", "landing")


def load() -> tuple[dict, dict]:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return dict(QUERIES), dict(ORACLES)
