"""Registered queries: one per operator, each with its DuckDB oracle text.

Every query reads the driver tables (through the derived views of
``netsieve.plans.derived``), so its work grows with the tables. Queries whose
semantics SQL cannot state carry no oracle and get a rows-only check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsieve.plans import derived as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def _load_all():
    # importing the modules registers their queries
    from netsieve.plans import (  # noqa: F401
        q_adapters, q_branches, q_core, q_joins, q_logs, q_ml, q_models, q_stateful, q_stream, q_windows)


def all_queries():
    _load_all()
    return dict(QUERIES)


def all_oracles():
    _load_all()
    return dict(ORACLES)
