"""Registered queries over the driver tables, each with its checking SQL."""

from __future__ import annotations

import importlib

FAMILIES = ("layout", "text", "chain", "attempts", "intake", "geometry", "events")


def catalogue() -> dict:
    """key -> (query function, checking SQL or None)."""
    found: dict = {}
    for family in FAMILIES:
        found.update(importlib.import_module(f"foliospark.plans.{family}").QUERIES)
    return found
