"""Registered queries with the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

from reviewloom.plans.registry import QUERIES, SQL, Query

MODULES = ["reviews", "corpus", "weighting", "storage", "models", "checks", "tuning"]


def _load() -> None:
    for name in MODULES:
        import_module(f"reviewloom.plans.{name}")


def all_queries() -> dict[str, Query]:
    _load()
    return QUERIES


def all_sql() -> dict[str, str]:
    _load()
    return SQL
