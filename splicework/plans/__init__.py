"""Registered queries over the given tables."""

from __future__ import annotations

import importlib

from .registry import QUERIES, Query

_MODULES = ("timeline_queries", "quality_queries", "signal_queries", "join_queries", "library_queries", "replay_queries", "review_queries", "text_queries", "event_queries", "training_queries")


def catalog() -> dict[str, Query]:
    for name in _MODULES:
        importlib.import_module(f".{name}", __name__)
    return dict(QUERIES)
