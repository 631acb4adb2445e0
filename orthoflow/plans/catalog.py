"""Registered queries (Spark) and their DuckDB oracle SQL, side by side.

Every query reads the driver tables at ``sf_dir`` (or data Spark derives from them) and
works on whole tables. Floating results that depend on summation order are reported as
printf-formatted significant digits or rounded decimals in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def sig(col, fmt: str = "%.5e"):
    """Significant-digit rendering shared with the oracle's printf."""
    return F.format_string(fmt, col)


def _load_all() -> None:
    # Importing the modules fills QUERIES / ORACLES.
    from orthoflow.plans import (  # noqa: F401
        q_compare, q_forms, q_generate, q_io, q_logs, q_runtree, q_steps, q_stream, q_svd,
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    _load_all()
    return dict(ORACLES)
