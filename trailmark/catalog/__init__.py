"""Registered queries over the given tables, each with an equivalent SQL text where one exists."""

from __future__ import annotations

from importlib import import_module

MODULES = [
    "rows",
    "lookups",
    "windows",
    "history",
    "sequence",
    "blocks",
    "screens",
    "alerts",
    "extras",
]


def load() -> dict:
    from trailmark.catalog import base

    for name in MODULES:
        import_module(f"trailmark.catalog.{name}")
    return base.REGISTRY
