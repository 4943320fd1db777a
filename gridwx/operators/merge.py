"""Sources side by side: precipitation, meteorology and solar series of points, day by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwx import catalog
from gridwx.grid import GridSpec
from gridwx.operators.points import with_nearest

SOLAR_FACTOR = 0.0864


def met_slice(met: DataFrame, wanted: list[str], first: str, last: str) -> DataFrame:
    """The wanted variables that exist; none is an error."""
    found = [c for c in wanted if c in met.columns]
    if not found:
        raise ValueError(f"none of {wanted} is in the table")
    return met.select("lat_idx", "lon_idx", "obs_date", *found).where(F.col("obs_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def canonical(met: DataFrame) -> DataFrame:
    return met.withColumnsRenamed({k: v for k, v in catalog.CANONICAL.items() if k in met.columns})


def bucket_ranges(buckets: DataFrame) -> DataFrame:
    """bucket, valid_from -> with valid_to, the day before the next bucket begins (the last one's is open). A handful of rows."""
    return buckets.withColumn("valid_to", F.date_sub(F.lead("valid_from").over(Window.orderBy("valid_from")), 1))


def solar_segments(solar: DataFrame, buckets: DataFrame) -> DataFrame:
    """Of each bucket the rows of its own time."""
    ranges = F.broadcast(bucket_ranges(buckets).withColumnRenamed("bucket", "_bucket"))
    own = (F.col("bucket") == F.col("_bucket")) & (F.col("obs_date") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("obs_date") <= F.col("valid_to")))
    return solar.join(ranges, own).select(*solar.columns)


def solar_dedup(solar: DataFrame, keys: list[str], buckets: DataFrame) -> DataFrame:
    """The row per key and day of the bucket that begins first. buckets: bucket, valid_from, a handful of rows."""
    starts = F.broadcast(buckets.select(F.col("bucket").alias("_bucket"), F.col("valid_from").alias("_from")))
    w = Window.partitionBy(*keys, "obs_date").orderBy(F.col("_from").asc_nulls_last(), "bucket")
    rows = solar.join(starts, solar["bucket"] == F.col("_bucket"), "left").withColumn("_n", F.row_number().over(w))
    return rows.where("_n = 1").select(*solar.columns)


def with_solar(met: DataFrame, solar: DataFrame, keys: list[str], fill: float | None = None) -> DataFrame:
    """Meteorology with SRAD in MJ/m2/day where there is any; `fill` replaces missing values, as export does."""
    srad = solar.select(*keys, "obs_date", (F.col("allsky_sfc_sw_dwn") * SOLAR_FACTOR).alias("SRAD"))
    joined = met.join(srad, [*keys, "obs_date"], "left")
    return joined if fill is None else joined.withColumn("SRAD", F.coalesce("SRAD", F.lit(fill)))


def merge_sources(rain: DataFrame, weather: DataFrame, keys: list[str], rain_source: str) -> DataFrame:
    """rain: keys, obs_date, RAIN. weather: keys, obs_date, RAIN1 and others.

    chirps: days of both, RAIN from the rain table; nasa_power: the weather's days, its RAIN1 as RAIN, the rain table is
    not read; both: days of both, two rain columns.
    """
    if rain_source == "chirps":
        return rain.join(weather.drop("RAIN1"), [*keys, "obs_date"])
    if rain_source == "nasa_power":
        return weather.withColumnRenamed("RAIN1", "RAIN")
    if rain_source == "both":
        return rain.join(weather, [*keys, "obs_date"])
    raise ValueError(f"unknown rain source {rain_source!r}")


#: The cells of both grids that a point takes its series from.
PLACE = ["fine_lat_idx", "fine_lon_idx", "coarse_lat_idx", "coarse_lon_idx"]


def places(points: DataFrame, fine: GridSpec, coarse: GridSpec) -> DataFrame:
    """points with the nearest cells of both grids; points without coordinates have none and are left out."""
    found = points.where("lat IS NOT NULL AND lon IS NOT NULL")
    return with_nearest(with_nearest(found, fine, "fine_"), coarse, "coarse_")


def place_series(located: DataFrame, grid: DataFrame, met: DataFrame, codes: list[str], rain_source: str) -> DataFrame:
    """PLACE, obs_date and the merged variables, once for each pair of cells that any point has, whatever the number of points.

    located: as `places` gives it. grid: with precipitation. met: with canonical names; codes are those that are taken.
    """
    pairs = located.select(*PLACE).distinct()
    rain = grid.select(F.col("lat_idx").alias("fine_lat_idx"), F.col("lon_idx").alias("fine_lon_idx"), "obs_date", F.col("precipitation").alias("RAIN"))
    weather = met.select(F.col("lat_idx").alias("coarse_lat_idx"), F.col("lon_idx").alias("coarse_lon_idx"), "obs_date", *codes)
    rain = pairs.join(rain, PLACE[:2]).select(*PLACE, "obs_date", "RAIN")
    weather = pairs.join(weather, PLACE[2:]).select(*PLACE, "obs_date", *codes)
    return merge_sources(rain, weather, PLACE, rain_source)


def series_by_source(series: dict[str, DataFrame], source: str, code: str) -> DataFrame:
    """The series of one variable as the named source has it, under its code; a source without it is an error.

    series: by source, keys and obs_date with a column per variable.
    """
    if source not in series:
        raise ValueError(f"unknown source {source!r}; there are {sorted(series)}")
    names = [code, *(["RAIN1"] if code == "RAIN" and source != "chirps" else [])]
    found = [c for c in names if c in series[source].columns]
    if not found:
        raise ValueError(f"{source} has no {code}")
    others = [c for c in series[source].columns if c not in {v for v, *_ in catalog.VARIABLES}]
    return series[source].select(*others, F.col(found[0]).alias(code))


def cross_resolution(fine: DataFrame, coarse: DataFrame, coarse_spec, fine_values: list[str], coarse_values: list[str]) -> DataFrame:
    """Every fine cell with the values of the nearest coarse cell, joined by index and day."""
    rows = fine.withColumn("c_lat", coarse_spec.nearest_lat(F.col("latitude"))).withColumn("c_lon", coarse_spec.nearest_lon(F.col("longitude")))
    other = coarse.select(F.col("lat_idx").alias("c_lat"), F.col("lon_idx").alias("c_lon"), "obs_date", *coarse_values)
    return rows.join(other, ["c_lat", "c_lon", "obs_date"]).select("lat_idx", "lon_idx", "obs_date", *fine_values, *coarse_values)


def tav_amp(series: DataFrame, keys: list[str], missing: float = -99.0) -> DataFrame:
    """Mean temperature, and half the range of the means of the single months; `missing` below a span of 365 days or without any.

    T2M is used if that column exists, else the mean of TMAX and TMIN.
    """
    if "T2M" in series.columns:
        t = F.col("T2M")
    elif {"TMAX", "TMIN"} <= set(series.columns):
        t = (F.col("TMAX") + F.col("TMIN")) / 2.0
    else:
        t = F.lit(None).cast("double")
    months = series.select(*keys, "obs_date", t.cast("double").alias("t")).groupBy(*keys, F.trunc("obs_date", "month").alias("month")).agg(
        F.sum("t").alias("s"), F.count("t").alias("n"), F.avg("t").alias("mean"), F.min("obs_date").alias("a"), F.max("obs_date").alias("b")
    )
    found = months.groupBy(*keys).agg(
        F.try_divide(F.sum("s"), F.sum("n")).alias("tav"), ((F.max("mean") - F.min("mean")) / 2).alias("amp"), (F.datediff(F.max("b"), F.min("a")) + 1).alias("span")
    )
    good = (F.col("span") >= 365) & F.col("tav").isNotNull()
    return found.select(*keys, F.when(good, F.bround("tav", 1)).otherwise(missing).alias("tav"), F.when(good, F.bround("amp", 1)).otherwise(missing).alias("amp"))


def variable_catalog(rows: DataFrame, variables: DataFrame, default: float = -99.0) -> DataFrame:
    """rows (column code, and others) with the catalogue's entries; unknown codes get the default. variables: the fixed table."""
    return rows.join(F.broadcast(variables), "code", "left").withColumn("default_value", F.coalesce("default_value", F.lit(default)))
