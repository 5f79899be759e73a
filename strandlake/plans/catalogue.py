"""All queries of the library by name, with their SQL twins."""

from __future__ import annotations

from importlib import import_module

from .base import ORACLES, QUERIES

for _name in ("sequences", "probability", "statistics", "curation", "experiments", "events", "sources"):
    import_module(f"{__package__}.{_name}")

__all__ = ["ORACLES", "QUERIES"]
