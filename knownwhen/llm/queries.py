"""The registered queries of the operators, each beside the SQL that checks it where SQL can express it."""

from __future__ import annotations

from importlib import import_module

from .common import ORACLES, QUERIES

MODULES = ("lines", "topk", "ngrams", "substrings", "spans", "mixing", "html", "quality", "embeddings", "bpe", "rules", "repair", "negatives")


def load() -> tuple[dict, dict]:
    for name in MODULES:
        import_module(f"{__package__}.{name}")
    return dict(QUERIES), dict(ORACLES)
