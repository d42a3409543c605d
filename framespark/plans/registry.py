"""Queries of the library's own operators on the test tables, with the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

GROUPS = ("frames", "scoring", "rasters", "selection", "polygons", "netlist", "storage", "structure", "sources")


def _gather(attribute: str) -> dict:
    found: dict = {}
    for group in GROUPS:
        found |= getattr(import_module(f"framespark.plans.{group}"), attribute)
    return found


def queries() -> dict:
    return _gather("Q")


def oracle_sql() -> dict[str, str]:
    return _gather("SQL")
