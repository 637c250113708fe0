"""All registered queries and their SQL checks."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("catalog_queries", "review_queries", "listing_queries", "model_queries", "source_queries", "summary_queries")

QUERIES: dict = {}
ORACLES: dict = {}
for _name in _MODULES:
    _module = import_module(f"{__package__}.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
