"""Operators for building training corpora, and their registered queries."""

from __future__ import annotations

import importlib

from .registry import CORPUS, CorpusQuery

_MODULES = ("ann", "chat", "decontaminate", "language", "line_dedup", "minhash", "mixing", "phrases", "quality", "secrets", "tries", "urls", "warc")


def catalog() -> dict[str, CorpusQuery]:
    for name in _MODULES:
        importlib.import_module(f".{name}", __name__)
    return dict(CORPUS)
