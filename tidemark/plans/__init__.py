"""Queries over the given tables, and the same in SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("snapshots", "changes", "dashboard", "places", "ingest")


def _registry():
    for name in MODULES:
        import_module(f"tidemark.plans.{name}")
    return import_module("tidemark.plans.registry")


def queries() -> dict:
    return dict(_registry().QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_registry().ORACLES)
