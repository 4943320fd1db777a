"""Registered queries: a Spark plan over the tables of a folder, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridwx.grid import GridSpec
from gridwx.plans.fixtures import fixture, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

FINE = GridSpec(0.225, 30.025, 0.05, 0.05, 10, 10)
COARSE = GridSpec(0.125, 30.125, 0.25, 0.25, 2, 2)
ELEVATION = GridSpec(0.2, 30.05, 0.1, 0.1, 5, 5)
FIRST, LAST = "2000-01-01", "2000-12-31"


def query(views: str = "", sql: str | None = None):
    """views: fixture names without fx_, separated by spaces; they become the function's arguments and the SQL's views."""
    names = tuple(f"fx_{v}" for v in views.split())

    def add(function: Callable) -> Callable:
        name = function.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(spark, sf_dir, *[fixture(spark, sf_dir, n) for n in names])

        QUERIES[name] = run
        if sql is not None:
            body = sql.strip()
            views_sql = with_views(names)
            if body.startswith(","):
                body = (views_sql.rstrip() if views_sql else "WITH one AS (SELECT 1)") + body
            else:
                body = views_sql + body
            ORACLES[name] = body
        return function

    return add
