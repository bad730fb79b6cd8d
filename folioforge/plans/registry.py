"""The registered queries of the library and their SQL for comparison."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def _longs(fn: Callable) -> Callable:
    """fn with 32-bit numbers in its result as 64-bit ones: one integer type in every report, as in SQL."""

    @functools.wraps(fn)
    def run(spark, sf_dir: str):
        out = fn(spark, sf_dir)
        return out.withColumns({c: F.col(c).cast("long") for c, kind in out.dtypes if kind == "int"})

    return run


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame, with SQL where SQL can express it."""

    def add(fn: Callable) -> Callable:
        QUERIES[name] = _longs(fn)
        if sql:
            ORACLES[name] = sql
        return fn

    return add
