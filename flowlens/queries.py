"""All queries by name, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

PLANS = ("explore", "flows", "detect", "dataset", "metrics", "cases", "models", "evidence", "selection")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _name in PLANS:
    _plan = import_module(f"flowlens.plans.{_name}")
    QUERIES |= _plan.QUERIES
    ORACLES |= _plan.ORACLES
