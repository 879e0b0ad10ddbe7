"""Queries and their oracle SQL, by name; each family of plans registers its own."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

FAMILIES: tuple[str, ...] = ("traffic", "search", "recommend", "kpi", "scalars", "gate", "exclude", "curation", "flows", "handover", "checks", "notices", "deadlines", "editing", "facts", "intake", "boards", "classify", "session_functions")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for _family in FAMILIES:
    _module = import_module(f"noticeloom.plans.{_family}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
