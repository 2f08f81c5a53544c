"""Registered queries, one module per family, each with its DuckDB counterpart where SQL can say it."""

from importlib import import_module

from sensorweave.catalog.base import ORACLES, QUERIES

FAMILIES = ["cleaning", "calendar", "features", "maps", "tables", "fuzzy", "training", "streams", "files"]

for _family in FAMILIES:
    import_module(f"sensorweave.catalog.{_family}")

__all__ = ["ORACLES", "QUERIES"]
