"""Kept monthly aggregates of a table of days: state that merges, brought up to date from new days alone.

The state of a cell and month is (n, mean, squares, low, high), squares being the sum of squared distances from the mean. It
is itself a table with a log, a "day" per month (its first). The log tells which day of the base table, in which load, is
in the state, and is published together with the months it speaks of, so that a refresh that dies or runs twice counts no
day twice.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwx.sources import daylog

CELL = ["lat_idx", "lon_idx"]
STATE = ["n", "mean", "squares", "low", "high"]
INCLUDED = "included"


def month_state(grid: DataFrame, value: str = "precipitation", keys: list[str] | None = None) -> DataFrame:
    """keys, obs_date (the month's first day) and STATE, from daily rows; nulls are skipped, months without values are none."""
    v = F.col(value).cast("double")
    found = grid.where(v.isNotNull()).groupBy(*(keys or CELL), F.trunc("obs_date", "month").alias("obs_date"))
    return found.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("squares"), F.min(v).alias("low"), F.max(v).alias("high"))


def merged(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Two states of disjoint days as one."""
    both = a.select(*by, F.struct(*STATE).alias("a")).join(b.select(*by, F.struct(*STATE).alias("b")), by, "full")

    def of(side: str, name: str, default: float = 0.0) -> Column:
        return F.coalesce(F.col(f"{side}.{name}"), F.lit(default))

    n = F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))
    mean = (of("a", "mean") * of("a", "n", 0) + of("b", "mean") * of("b", "n", 0)) / n
    gap = of("b", "mean") - of("a", "mean")
    squares = of("a", "squares") + of("b", "squares") + gap * gap * of("a", "n", 0) * of("b", "n", 0) / n
    return both.select(*by, n.cast("long").alias("n"), mean.alias("mean"), squares.alias("squares"), F.least("a.low", "b.low").alias("low"), F.greatest("a.high", "b.high").alias("high"))


def refresh(spark: SparkSession, base: str, kept: str, value: str = "precipitation", keys: list[str] | None = None) -> DataFrame:
    """Bring the state at `kept` up to date with the table at `base`; returns obs_date, cells of the months that changed.

    Only days that came since the last refresh are read from the base table; a month that holds a day loaded anew or gone
    is made again from its own days.
    """
    by = [*(keys or CELL), "obs_date"]
    loads = {str(r["obs_date"]): r["load"] for r in daylog.days(spark, base).collect()}
    there = daylog.exists(spark, kept)
    before = json.loads(daylog.properties(spark, kept)[INCLUDED]) if there else {}
    new = {d for d in loads if d not in before}
    again = {d[:7] for d, load in before.items() if loads.get(d) != load}
    wanted = sorted(d for d in loads if d in new or d[:7] in again)
    included = {INCLUDED: json.dumps(loads)}
    state = month_state(daylog.read_days(spark, base, wanted), value, keys)
    if not there:
        return daylog.create(spark, kept, state, included)
    touched = sorted({f"{d[:7]}-01" for d in new if d[:7] not in again})
    return daylog.append(spark, kept, merged(daylog.read_days(spark, kept, touched), state, by), True, included)


def monthly(spark: SparkSession, kept: str) -> DataFrame:
    """Per cell and month (by its last day, as resampling labels it): n, mean, std, low, high."""
    rows = daylog.read(spark, kept)
    return rows.withColumn("bin", F.last_day("obs_date")).withColumn("std", F.sqrt(F.col("squares") / F.col("n"))).drop("obs_date", "squares")


def climatology(spark: SparkSession, kept: str, by_month: bool = True, keys: list[str] | None = None) -> DataFrame:
    """Long-range mean per cell, and calendar month, from the state alone."""
    by = [*(keys or CELL)] + ([F.month("obs_date").alias("month")] if by_month else [])
    return daylog.read(spark, kept).groupBy(*by).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"))
