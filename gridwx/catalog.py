"""Fixed tables: variables, named regions and date ranges, rain sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Code, description, units, decimals, default for missing values in files, source.
VARIABLES = [
    ("RAIN1", "Precipitation from NASA POWER (mm/day)", "mm/day", 1, 0.0, "NASA_POWER"),
    ("RAIN", "Precipitation (mm/day)", "mm/day", 1, 0.0, "HYBRID"),
    ("T2M", "Temperature at 2 Meters (°C)", "°C", 1, -99.0, "NASA_POWER"),
    ("TMAX", "Temperature at 2 Meters Maximum (°C)", "°C", 1, -99.0, "NASA_POWER"),
    ("TMIN", "Temperature at 2 Meters Minimum (°C)", "°C", 1, -99.0, "NASA_POWER"),
    ("TDEW", "Dew/Frost Point at 2 Meters (°C)", "°C", 1, -99.0, "NASA_POWER"),
    ("RH2M", "Relative Humidity at 2 Meters (%)", "%", 1, -99.0, "NASA_POWER"),
    ("WIND", "Wind Speed at 2 Meters (m/s)", "m/s", 1, -99.0, "NASA_POWER"),
    ("SRAD", "All Sky Surface Shortwave Downward Irradiance (MJ/m²/day)", "MJ/m²/day", 1, -99.0, "NASA_POWER"),
]
# Region, lon_min, lon_max, lat_min, lat_max.
REGIONS = [
    ("angola", 14.0, 21.0, -17.0, -8.0),
    ("west_africa", -10.0, 17.0, 7.0, 28.0),
    ("southern_africa", 18.0, 29.0, -29.0, -10.0),
    ("sahel", -2.5, 1.0, 12.0, 15.5),
    ("horn_of_africa", 39.0, 46.0, 3.0, 10.0),
    ("wyoming", -111.0, -104.0, 41.0, 45.0),
]
# Range, first day, last day.
DATE_RANGES = [
    ("single_day", "2024-01-01", "2024-01-01"),
    ("one_week", "2024-01-01", "2024-01-07"),
    ("one_month", "2024-01-01", "2024-01-31"),
    ("three_months", "2024-01-01", "2024-03-31"),
    ("one_year", "2023-01-01", "2023-12-31"),
    ("full_dataset", "2023-01-01", "2024-12-31"),
]
# Names in the meteorology tables and in output.
CANONICAL = {"t2m": "T2M", "t2m_max": "TMAX", "t2m_min": "TMIN", "prectotcorr": "RAIN1", "t2mdew": "TDEW", "ws2m": "WIND", "rh2m": "RH2M"}
# Comparison sources in order of preference, labels, and the names an outside service has for the variables.
SOURCES = [("chirps", "CHIRPS (Zarr)"), ("nasa_s3", "NASA POWER S3"), ("nasa_api", "NASA POWER API"), ("open_meteo", "Open-Meteo")]
RAIN_SOURCES = ["chirps", "nasa_s3", "nasa_api", "open_meteo"]
OTHER_SOURCES = ["nasa_s3", "nasa_api"]
EXTERNAL_NAMES = {
    "RAIN": "PRECTOTCORR",
    "T2M": "T2M",
    "TMIN": "T2M_MIN",
    "TMAX": "T2M_MAX",
    "TDEW": "T2MDEW",
    "RH2M": "RH2M",
    "WIND": "WS2M",
    "SRAD": "ALLSKY_SFC_SW_DWN",
}


def variables(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VARIABLES, "code string, description string, units string, decimals int, default_value double, source string")


def regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGIONS, "region string, lon_min double, lon_max double, lat_min double, lat_max double")


def region_bounds(name: str) -> tuple[float, float, float, float]:
    for region, *bounds in REGIONS:
        if region == name:
            return tuple(bounds)
    raise ValueError(f"unknown region {name!r}; there are {[r[0] for r in REGIONS]}")


def date_range(name: str) -> tuple[str, str]:
    for range_, first, last in DATE_RANGES:
        if range_ == name:
            return first, last
    raise ValueError(f"unknown date range {name!r}; there are {[r[0] for r in DATE_RANGES]}")
