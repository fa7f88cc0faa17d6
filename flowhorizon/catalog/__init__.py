"""Registered queries over the driver tables."""

from __future__ import annotations

import importlib

MODULES = ["flow_queries", "sequence_queries", "evaluation_queries", "audit_queries", "source_queries"]


def load():
    """Import every query module once; returns (queries, oracles)."""
    from . import registry

    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return dict(registry.QUERIES), dict(registry.ORACLES)
