"""Means over calendar bins, labelled by the bin's last day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bin_label(day: Column, every: str) -> Column:
    """Sunday of the week, last day of the month, 31 December."""
    if every == "weekly":
        return F.date_add(F.date_trunc("week", day).cast("date"), 6)
    if every == "monthly":
        return F.last_day(day)
    if every == "yearly":
        return F.make_date(F.year(day), F.lit(12), F.lit(31))
    if every == "daily":
        return day
    raise ValueError(f"unknown aggregation {every!r}")


def resample(rows: DataFrame, every: str, keys: list[str], values: list[str]) -> DataFrame:
    return rows.groupBy(*keys, bin_label(F.col("obs_date"), every).alias("bin")).agg(*[F.avg(v).alias(v) for v in values])


def resample_gapfilled(rows: DataFrame, every: str, keys: list[str], values: list[str]) -> DataFrame:
    """As resample, with a null row for each empty bin between a key's first and last."""
    found = resample(rows, every, keys, values)
    step = {"daily": "interval 1 day", "weekly": "interval 7 days", "monthly": "interval 1 month", "yearly": "interval 1 year"}[every]
    first, last = F.min("bin"), F.max("bin")
    if every == "monthly":  # from first days, so that every step lands in its month
        first, last = F.trunc(first, "month"), F.trunc(last, "month")
    spine = found.groupBy(*keys).agg(F.sequence(first, last, F.expr(step)).alias("bins")).select(*keys, F.explode("bins").alias("bin"))
    spine = spine.withColumn("bin", bin_label(F.col("bin"), every))
    return spine.join(found, [*keys, "bin"], "left")


def seasonal_sum(rows: DataFrame, months: list[int], keys: list[str], value: str = "precipitation") -> DataFrame:
    """Sum over the named months of each year."""
    return rows.where(F.month("obs_date").isin(months)).groupBy(*keys, F.year("obs_date").alias("year")).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("total"))
