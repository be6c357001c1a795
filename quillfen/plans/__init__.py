"""Multi-table plans and the registered queries."""

from __future__ import annotations

import importlib

_FAMILIES = (
    "tables", "joining", "charts", "series", "profiling", "mining", "cleaning", "texts", "business", "derived",
)


def all_queries():
    """(queries, oracle SQL), keyed by query name."""
    from quillfen.plans import registry

    for family in _FAMILIES:
        importlib.import_module(f"quillfen.plans.{family}_queries")
    return registry.QUERIES, registry.ORACLES
