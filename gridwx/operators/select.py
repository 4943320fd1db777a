"""Selections by day, box, region and cell. Bounds become index literals too, so that they reach the scan."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwx import catalog
from gridwx.grid import GridSpec
from gridwx.workspace import staged


def single_date(grid: DataFrame, day: str | date) -> DataFrame:
    """The rows of a day; a day without rows is an error."""
    found = grid.where(F.col("obs_date") == F.lit(day).cast("date"))
    if found.isEmpty():
        raise ValueError(f"no data for {day}")
    return found


def date_range(grid: DataFrame, first: str | date, last: str | date) -> DataFrame:
    """Both ends belong to the range."""
    return grid.where(F.col("obs_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def named_range(grid: DataFrame, name: str) -> DataFrame:
    return date_range(grid, *catalog.date_range(name))


def local_subset(grid: DataFrame, points_bounds: DataFrame, spec: GridSpec) -> DataFrame:
    """The cells from those nearest to the bounds' corners inwards, written once to be read again and again.

    points_bounds: one row of lat_min, lat_max, lon_min, lon_max. Every point within has its nearest cell there.
    """
    box = points_bounds.first()
    r0, c0 = spec.nearest_index(box["lat_max"], box["lon_min"])
    r1, c1 = spec.nearest_index(box["lat_min"], box["lon_max"])
    return staged(grid.where(F.col("lat_idx").between(r0, r1) & F.col("lon_idx").between(c0, c1)), "subset")


def bbox(grid: DataFrame, lat_min: float, lat_max: float, lon_min: float, lon_max: float, first: str | None = None, last: str | None = None, spec: GridSpec | None = None) -> DataFrame:
    """Closed box; the order of each axis' bounds does not matter; days only if both are given."""
    south, north = sorted((lat_min, lat_max))
    west, east = sorted((lon_min, lon_max))
    if spec:
        r0, r1, c0, c1 = spec.box_index(south, north, west, east)
        grid = grid.where(F.col("lat_idx").between(r0, r1) & F.col("lon_idx").between(c0, c1))
    found = grid.where(F.col("latitude").between(south, north) & F.col("longitude").between(west, east))
    return date_range(found, first, last) if first and last else found


def region(grid: DataFrame, name: str, first: str | None = None, last: str | None = None, spec: GridSpec | None = None) -> DataFrame:
    lon_min, lon_max, lat_min, lat_max = catalog.region_bounds(name)
    return bbox(grid, lat_min, lat_max, lon_min, lon_max, first, last, spec)


def around(grid: DataFrame, lat: float, lon: float, half_width: float = 0.5, spec: GridSpec | None = None) -> DataFrame:
    return bbox(grid, lat - half_width, lat + half_width, lon - half_width, lon + half_width, spec=spec)


def nearest_cell(grid: DataFrame, spec: GridSpec, lat: float, lon: float) -> DataFrame:
    row, col = spec.nearest_index(lat, lon)
    return grid.where((F.col("lat_idx") == row) & (F.col("lon_idx") == col))


def box_centre_cell(grid: DataFrame, spec: GridSpec, lat_min: float, lat_max: float, lon_min: float, lon_max: float) -> DataFrame:
    """A box's series is that of the cell nearest to its centre."""
    return nearest_cell(grid, spec, (lat_min + lat_max) / 2, (lon_min + lon_max) / 2)


def pixel_window(grid: DataFrame, spec: GridSpec, lat_min: float, lat_max: float, lon_min: float, lon_max: float) -> DataFrame:
    """Half-open window of pixels, its bounds cut to whole pixels."""
    top, left = spec.lat0 + spec.dlat / 2, spec.lon0 - spec.dlon / 2
    r0, r1 = int((top - lat_max) / spec.dlat), int((top - lat_min) / spec.dlat)
    c0, c1 = int((lon_min - left) / spec.dlon), int((lon_max - left) / spec.dlon)
    return grid.where((F.col("lat_idx") >= r0) & (F.col("lat_idx") < r1) & (F.col("lon_idx") >= c0) & (F.col("lon_idx") < c1))


def cell_sample(grid: DataFrame, n: int, *keys: str) -> DataFrame:
    """n rows in order of a hash of their keys: the same rows each time, without regard to how the table is laid out."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return grid.orderBy(F.md5(text), *keys).limit(n)


def latest_month(grid: DataFrame) -> DataFrame:
    """First and last day of the calendar month that holds the latest day."""
    latest = F.max("obs_date")
    return grid.agg(F.trunc(latest, "month").alias("first_day"), F.last_day(latest).alias("last_day"))


def valid_coordinates(lat: Column, lon: Column) -> Column:
    return lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)


def range_overlap(data: DataFrame, first: str, last: str) -> DataFrame:
    """Does the data's range meet the requested one, and the common part of both (null if there is none)."""
    a, b = F.lit(first).cast("date"), F.lit(last).cast("date")
    row = data.agg(F.min("obs_date").alias("ds_start"), F.max("obs_date").alias("ds_end"))
    meets = (a <= F.col("ds_end")) & (b >= F.col("ds_start"))
    return row.select("ds_start", "ds_end", meets.alias("overlaps"), F.when(meets, F.greatest(a, "ds_start")).alias("clip_start"), F.when(meets, F.least(b, "ds_end")).alias("clip_end"))


def parse_parameters(csv: Column, allowed: list[str], rain_source: Column) -> list[Column]:
    """selected (trimmed, upper case, each once, in order), invalid, and whether RAIN1 is asked for without both sources."""
    parts = F.transform(F.split(csv, ","), lambda x: F.upper(F.trim(x)))
    selected = F.array_distinct(F.filter(parts, lambda x: x != ""))
    options = F.array(*[F.lit(v) for v in allowed])
    return [
        selected.alias("selected"),
        F.array_except(selected, options).alias("invalid"),
        F.array_intersect(selected, options).alias("usable"),
        (F.array_contains(selected, "RAIN1") & (rain_source != "both")).alias("rain1_needs_both"),
    ]
