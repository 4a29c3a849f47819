"""Registered queries, each beside the SQL that checks it."""

from __future__ import annotations

import importlib
from types import SimpleNamespace

MODULES = ("reading", "ranking", "ledger", "quality", "columns", "sinks", "streams", "matching")


def load() -> SimpleNamespace:
    """Import every query module and return what they registered."""
    for name in MODULES:
        importlib.import_module(f"dispatchery.plans.{name}")
    from dispatchery.plans.registry import ORACLES, QUERIES

    return SimpleNamespace(queries=QUERIES, oracles=ORACLES)
