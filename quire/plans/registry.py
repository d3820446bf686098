"""Every query of the engine's own operators, with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.plans.views_sql import VIEWS
from quire.sources.adapters import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: bool = True):
    """Registers a function of Tables under name; sql is what DuckDB says to the same question."""

    def add(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        run.__name__ = name
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql:
            SQL[name] = VIEWS + sql if views else sql
        return f

    return add


from quire.plans import catalog, exports, layouts, review, texts  # noqa: E402, F401
