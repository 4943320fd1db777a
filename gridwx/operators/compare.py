"""Two sources against each other, and statistics of single series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwx.functions.values import finite, round1

TOLERANCE = 1e-6


def compare_sources(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Days on which both sources have a value, each with one decimal (half up)."""
    left = a.select(*keys, "obs_date", round1(finite(F.col("value")), "js").alias("source1")).where("source1 IS NOT NULL")
    right = b.select(*keys, "obs_date", round1(finite(F.col("value")), "js").alias("source2")).where("source2 IS NOT NULL")
    return left.join(right, [*keys, "obs_date"])


def series_stats(series: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    v = finite(F.col(value))
    return series.groupBy(*keys).agg(
        F.count(v).alias("available"), (F.count(F.lit(1)) - F.count(v)).alias("missing"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.coalesce(F.sum(v), F.lit(0.0)).alias("sum")
    )


def compare_stats(points: DataFrame, keys: list[str]) -> DataFrame:
    """points: rows of compare_sources. Nothing compared gives zeros (for no keys)."""
    d = F.col("source1") - F.col("source2")
    zero = F.lit(0.0)
    return points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("compared"), F.count_if(F.abs(d) > TOLERANCE).alias("different"), F.coalesce(F.sum(d), zero).alias("sum_diff"), F.coalesce(F.sum(F.abs(d)), zero).alias("sum_abs_diff"),
        F.coalesce(F.avg(F.abs(d)), zero).alias("mean_abs_diff"), F.coalesce(F.max(F.abs(d)), zero).alias("max_abs_diff"),
    )


def common_days(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("obs_date").intersect(b.select("obs_date"))


def compare_report(points: DataFrame, keys: list[str]) -> DataFrame:
    """A padded line for each day on which the sources differ."""
    rows = points.where(F.abs(F.col("source1") - F.col("source2")) > TOLERANCE)
    return rows.select(*keys, "obs_date", F.format_string("%-12s | %14.6f | %14.6f", F.col("obs_date").cast("string"), "source1", "source2").alias("line"))
