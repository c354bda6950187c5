"""Every registered query with its oracle, one module per family."""

from __future__ import annotations

import importlib

MODULES = ["olap", "cleaning", "scalars", "relational", "statistics", "mining", "learning"]


def queries() -> dict:
    return _merge("QUERIES")


def oracles() -> dict:
    return _merge("ORACLES")


def _merge(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        entries = getattr(importlib.import_module(f"wayfarer.catalog.{name}"), attribute)
        clash = merged.keys() & entries.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        merged.update(entries)
    return merged
