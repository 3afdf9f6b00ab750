"""name -> query and SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.adapters import Tables
from .base_sql import twin

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *needs: str) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Registers a query over Tables under the function's name."""

    def register(make: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        name = make.__name__
        QUERIES[name] = lambda spark, sf_dir: make(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = twin(sql, *needs)
        return make

    return register
