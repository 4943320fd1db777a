"""Series of other services: one JSON document to rows of day and value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwx.functions.values import iso_day, missing_to_null


def from_map(documents: DataFrame, keys: list[str], column: str) -> DataFrame:
    """A map from YYYYMMDD to a value; sentinels become null."""
    rows = documents.select(*keys, F.explode(F.from_json(column, "map<string,double>")).alias("k", "value"))
    return rows.select(*keys, F.to_date("k", "yyyyMMdd").alias("obs_date"), missing_to_null(F.col("value")).alias("value"))


def from_arrays(documents: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Two parallel arrays, time and value."""
    parsed = documents.select(*keys, F.from_json(column, "time array<string>, value array<double>").alias("d"))
    rows = parsed.select(*keys, F.explode(F.arrays_zip(F.col("d.time").alias("time"), F.col("d.value").alias("value"))).alias("z"))
    return rows.select(*keys, iso_day(F.col("z.time")).alias("obs_date"), missing_to_null(F.col("z.value")).alias("value"))
