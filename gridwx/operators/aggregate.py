"""Temporal, spatial and regional statistics. Nulls are skipped; sums of nothing are 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwx.functions.values import percentage, round1
from gridwx.operators.ordered import exact_quantiles

CELL = ["lat_idx", "lon_idx"]
WET = 0.1


def temporal_mean(grid: DataFrame, value: str = "precipitation") -> DataFrame:
    return grid.groupBy(*CELL).agg(F.avg(value).alias("mean"))


def temporal_sum(grid: DataFrame, value: str = "precipitation") -> DataFrame:
    return grid.groupBy(*CELL).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("total"))


def spatial_mean(grid: DataFrame, value: str = "precipitation") -> DataFrame:
    return grid.agg(F.avg(value).alias("mean"))


def area_average(grid: DataFrame, value: str = "precipitation") -> DataFrame:
    """Mean of each day, and the cells of the box that the grid came from."""
    return grid.groupBy("obs_date").agg(
        F.avg(value).alias("mean"), (F.count_distinct("lat_idx") * F.count_distinct("lon_idx")).alias("grid_cells")
    )


def region_stats(grid: DataFrame, regions: DataFrame, value: str = "precipitation") -> DataFrame:
    """All regions and all statistics in one pass; a cell may belong to several regions. regions: a handful of boxes."""
    inside = F.col("latitude").between(F.col("lat_min"), F.col("lat_max")) & F.col("longitude").between(F.col("lon_min"), F.col("lon_max"))
    # days of one cell are added up before the boxes are looked at
    v = F.col(value).cast("double")
    cells = grid.groupBy("latitude", "longitude").agg(
        F.count(v).alias("n"), F.sum(v).alias("s"), F.avg(v).alias("m"), F.var_pop(v).alias("q"), F.min(v).alias("lo"), F.max(v).alias("hi")
    )
    cells = cells.join(F.broadcast(regions), inside)
    # the squares within cells and those of the cells' means from the region's, which do not cancel
    means = cells.groupBy("region").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("mean"))
    spread = F.col("n") * (F.col("q") + (F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean")))
    found = cells.join(F.broadcast(means), "region").groupBy("region", "mean").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(spread).alias("q"), F.min("lo").alias("min"), F.max("hi").alias("max")
    )
    return found.select(
        "region",
        "mean",
        F.sqrt(F.try_divide("q", "n")).alias("std"),
        "min",
        "max",
        F.coalesce("s", F.lit(0.0)).alias("sum"),
        F.col("n").alias("n_values"),
    )


def wet_dry_stats(points: DataFrame, keys: list[str], value: str = "precipitation", rain: bool = True) -> DataFrame:
    """Statistics of all days and of the wet days alone, on values of one decimal.

    The days' values are rounded in single precision, so that 0.05 is dry. For other variables than rain every day counts
    as wet and there are no rain totals. Without wet days their statistics are 0.
    """
    v = round1(F.col(value), "np32").cast("double")
    rows = points.select(*keys, v.alias("v"))
    wet = (F.col("v") >= WET_SINGLE) if rain else F.col("v").isNotNull()
    only = F.when(wet, F.col("v"))
    zero = F.lit(0.0)
    aggregates = [
        F.coalesce(F.sum("v"), zero).alias("all_total"),
        F.avg("v").alias("all_mean"),
        F.percentile("v", F.lit(0.5)).alias("all_median"),
        F.max("v").alias("all_max"),
        F.min("v").alias("all_min"),
        F.stddev_pop("v").alias("all_std"),
        F.count(only).alias("wet_days"),
        (F.count("v") - F.count(only)).alias("dry_days"),
        F.coalesce(F.sum(only), zero).alias("wet_total"),
        F.coalesce(F.avg(only), zero).alias("wet_mean"),
        F.coalesce(F.percentile(only, F.lit(0.5)), zero).alias("wet_median"),
        F.coalesce(F.max(only), zero).alias("wet_max"),
        F.coalesce(F.min(only), zero).alias("wet_min"),
        F.coalesce(F.stddev_pop(only), zero).alias("wet_std"),
    ]
    return rows.groupBy(*keys).agg(*aggregates)


#: 0.1 in single precision, which rounded values are compared with.
WET_SINGLE = 0.10000000149011612


def variable_stats(long: DataFrame, rain_codes: list[str]) -> DataFrame:
    """code, value -> statistics per variable; totals, wet and dry days for rain only; every day of another counts as wet."""
    v = round1(F.col("value"), "js")
    rain = F.col("code").isin(*rain_codes)
    rows = long.select("code", v.alias("v")).where("v IS NOT NULL").withColumn("wet", ~rain | (F.col("v") >= WET))
    found = rows.groupBy("code").agg(
        F.sum("v").alias("total"), F.avg("v").alias("mean"), F.percentile("v", F.lit(0.5)).alias("median"), F.max("v").alias("max"), F.min("v").alias("min"),
        F.stddev_pop("v").alias("std"), F.count_if("wet").alias("wet_days"), F.count_if(~F.col("wet")).alias("dry_days"),
        F.avg(F.when(F.col("wet"), F.col("v"))).alias("wet_mean"),
    )
    total = F.when(rain, F.col("total"))
    return found.withColumn("total", total).withColumn("rain_pct", F.when(rain, percentage(F.col("wet_days"), F.col("wet_days") + F.col("dry_days"))))


def quantiles(df: DataFrame, group: list[str], value: str, levels: list[float], accuracy: int | None = None) -> DataFrame:
    """group columns and q (array): exact with linear interpolation, however many values there are; with an accuracy, an
    approximation in one pass. Groups without values are left out."""
    if accuracy is None:
        return exact_quantiles(df, group, value, levels)
    found = F.percentile_approx(value, F.array(*[F.lit(x) for x in levels]), accuracy)
    return df.groupBy(*group).agg(found.alias("q")).where("q IS NOT NULL")


def daily_grid_summary(grid: DataFrame, value: str = "precipitation", accuracy: int | None = None) -> DataFrame:
    days = grid.groupBy("obs_date").agg(
        F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.stddev_pop(value).alias("std"),
        F.count(value).alias("valid"), F.count(F.lit(1)).alias("cells"),
    )
    q = days.join(quantiles(grid, ["obs_date"], value, [0.25, 0.5, 0.75, 0.95], accuracy), "obs_date", "left")
    names = ["p25", "median", "p75", "p95"]
    return q.select("obs_date", "mean", "min", "max", "std", "valid", "cells", percentage(F.col("valid"), F.col("cells")).alias("valid_pct"), *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(names)])


def percentile_profile(grid: DataFrame, value: str = "precipitation", levels: tuple[int, ...] = (0, 10, 25, 50, 75, 90, 95, 99, 100), accuracy: int | None = None) -> DataFrame:
    """Quantiles of all values at once, exact or with an accuracy (ranks off by at most 1 / accuracy); none without values."""
    q = quantiles(grid, [], value, [x / 100 for x in levels], accuracy)
    return q.select(F.posexplode("q").alias("i", "value")).select(F.get(F.array(*[F.lit(x) for x in levels]), F.col("i")).alias("level"), "value")


def daily_mean_extremes(grid: DataFrame, value: str = "precipitation") -> DataFrame:
    """Over the daily means: mean, sample deviation, extremes with their (earliest) day; highest value, mean coverage."""
    days = grid.groupBy("obs_date").agg(F.avg(value).alias("mean"), F.max(value).alias("max"), percentage(F.count(value), F.count(F.lit(1))).alias("pct"))
    low = F.min(F.when(F.col("mean").isNotNull(), F.struct("mean", "obs_date")))
    high = F.min(F.when(F.col("mean").isNotNull(), F.struct((-F.col("mean")).alias("mean"), "obs_date")))
    row = days.agg(F.avg("mean").alias("mean_of_means"), F.stddev_samp("mean").alias("std_of_means"), low.alias("low"), high.alias("high"), F.max("max").alias("global_max"), F.avg("pct").alias("mean_coverage"))
    return row.select("mean_of_means", "std_of_means", F.col("low.mean").alias("min_mean"), F.col("low.obs_date").alias("min_date"), (-F.col("high.mean")).alias("max_mean"), F.col("high.obs_date").alias("max_date"), "global_max", "mean_coverage")


def histogram(grid: DataFrame, value: str = "precipitation", bins: int = 50) -> DataFrame:
    """Equal-width bins over the value's range, the last one closed."""
    rows = grid.select(F.col(value).alias("v")).where("v IS NOT NULL")
    ends = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    bin_ = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins), (F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)) + 1).cast("int"))).otherwise(1)
    return rows.join(F.broadcast(ends)).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def latitude_bands(grid: DataFrame, nlat: int, bands: int = 10, value: str = "precipitation", accuracy: int | None = None) -> DataFrame:
    """Quartiles and whiskers (the extreme values within 1.5 quartile distances) per band; the last takes the remainder.

    Exact, or with an accuracy (ranks off by at most 1 / accuracy) in one pass.
    """
    rows = grid.withColumn("band", F.least((F.col("lat_idx") / F.lit(max(1, nlat // bands))).cast("int"), F.lit(bands - 1))).where(F.col(value).isNotNull())
    q = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).join(quantiles(rows, ["band"], value, [0.25, 0.5, 0.75], accuracy), "band")
    q = q.select("band", "n", *[F.get("q", F.lit(i)).alias(c) for i, c in enumerate(("q1", "median", "q3"))])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    within = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    ends = rows.join(F.broadcast(q), "band").where(within).groupBy("band").agg(F.min(value).alias("low"), F.max(value).alias("high"))
    return q.join(ends, "band")


def distinct_values(grid: DataFrame, value: str = "precipitation", n: int = 10) -> DataFrame:
    """The n smallest and n largest distinct values, and how many there are."""
    values = grid.select(F.col(value).alias("value")).where("value IS NOT NULL").distinct()
    count = values.agg(F.count(F.lit(1)).alias("n_distinct"))
    low = values.orderBy("value").limit(n).withColumn("side", F.lit("first"))
    high = values.orderBy(F.desc("value")).limit(n).withColumn("side", F.lit("last"))
    return low.unionByName(high).join(F.broadcast(count))


def region_day_stats(grid: DataFrame, value: str = "precipitation", accuracy: int | None = None) -> DataFrame:
    """Statistics of each day of a window of pixels."""
    days = grid.groupBy("obs_date").agg(
        F.count_distinct("lat_idx").alias("n_rows"), F.count_distinct("lon_idx").alias("n_cols"), F.count(value).alias("valid"), percentage(F.count(value), F.count(F.lit(1))).alias("valid_pct"),
        F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
    )
    q = days.join(quantiles(grid, ["obs_date"], value, [0.25, 0.5, 0.75, 0.9, 0.95], accuracy), "obs_date", "left")
    names = ["p25", "median", "p75", "p90", "p95"]
    return q.select(*days.columns, *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(names)])


def climatology(grid: DataFrame, by_month: bool = True, value: str = "precipitation") -> DataFrame:
    keys = [*CELL] + ([F.month("obs_date").alias("month")] if by_month else [])
    return grid.groupBy(*keys).agg(F.avg(value).alias("mean"))


def anomaly(current: DataFrame, reference: DataFrame) -> DataFrame:
    """Difference of two maps (cell, mean)."""
    a, b = current.withColumnRenamed("mean", "now"), reference.withColumnRenamed("mean", "usual")
    return a.join(b, CELL).select(*CELL, (F.col("now") - F.col("usual")).alias("anomaly"))


def declared_vs_computed(declared: DataFrame, raw: DataFrame, key: str, value: str) -> DataFrame:
    """declared: key, declared_min, declared_max. Raw values keep their sentinels."""
    found = raw.groupBy(key).agg(F.min(value).alias("computed_min"), F.max(value).alias("computed_max"))
    same = F.col("declared_min").eqNullSafe(F.col("computed_min")) & F.col("declared_max").eqNullSafe(F.col("computed_max"))
    return declared.join(found, key, "left").withColumn("same", same)


def availability_by_year(days: DataFrame, dataset: str = "dataset") -> DataFrame:
    return days.groupBy(dataset, F.year("obs_date").alias("year")).agg(F.min("obs_date").alias("first_day"), F.max("obs_date").alias("last_day"), F.count_distinct("obs_date").alias("n_days"))


def series_equal(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows on one side only, largest difference, and whether all values are close."""
    both = a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b"), F.lit(1).alias("in_b")), keys, "full")
    gap = F.abs(F.col("a") - F.col("b"))
    close = F.coalesce(gap <= 1e-8 + 1e-5 * F.abs("b"), F.col("a").isNull() & F.col("b").isNull())
    return both.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(gap), F.lit(0.0)).alias("max_difference"), F.coalesce(F.bool_and(close), F.lit(True)).alias("all_close"))


def points_bounds(points: DataFrame) -> DataFrame:
    """Bounding box of a set of points; an empty set is an error."""
    if points.isEmpty():
        raise ValueError("no points")
    return points.agg(F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"), F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"))


def coarsen(grid: DataFrame, degrees: float, value: str = "precipitation") -> DataFrame:
    """Means over cells of another resolution."""
    return grid.groupBy(F.floor(F.col("latitude") / degrees).cast("int").alias("lat_cell"), F.floor(F.col("longitude") / degrees).cast("int").alias("lon_cell")).agg(F.avg(value).alias("mean"))


def log_scale(value: Column) -> Column:
    return F.log10(value + 0.01)
