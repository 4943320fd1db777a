"""Regular grids: index arithmetic instead of searching coordinates. Latitude descends with its index, longitude ascends."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GridSpec:
    """lat0/lon0: centre of the first cell (north-west); dlat/dlon: positive steps in degrees."""

    lat0: float
    lon0: float
    dlat: float
    dlon: float
    nlat: int
    nlon: int

    def nearest_lat(self, lat: Column) -> Column:
        """Index of the nearest row, clamped to the grid; a tie takes the larger latitude."""
        u = (F.lit(self.lat0) - lat) / F.lit(self.dlat)
        return F.greatest(F.lit(0), F.least(F.lit(self.nlat - 1), F.ceil(u - F.lit(0.5)).cast("int")))

    def nearest_lon(self, lon: Column) -> Column:
        """Index of the nearest column, clamped to the grid; a tie takes the larger longitude."""
        u = (lon - F.lit(self.lon0)) / F.lit(self.dlon)
        return F.greatest(F.lit(0), F.least(F.lit(self.nlon - 1), F.floor(u + F.lit(0.5)).cast("int")))

    def containing(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        """Row and column of the cell whose area holds the point; outside the grid the indices are out of range."""
        row = F.floor((F.lit(self.lat0 + self.dlat / 2) - lat) / F.lit(self.dlat)).cast("int")
        col = F.floor((lon - F.lit(self.lon0 - self.dlon / 2)) / F.lit(self.dlon)).cast("int")
        return row, col

    def nearest_index(self, lat: float, lon: float) -> tuple[int, int]:
        """nearest_lat and nearest_lon of one point, as literals that reach the scan."""
        import math

        row = min(self.nlat - 1, max(0, math.ceil((self.lat0 - lat) / self.dlat - 0.5)))
        col = min(self.nlon - 1, max(0, math.floor((lon - self.lon0) / self.dlon + 0.5)))
        return row, col

    def box_index(self, lat_min: float, lat_max: float, lon_min: float, lon_max: float) -> tuple[int, int, int, int]:
        """First and last row, first and last column whose centres can lie in the closed box, one cell wider for rounding."""
        import math

        low, high = sorted((lat_min, lat_max))
        west, east = sorted((lon_min, lon_max))
        return (
            max(0, math.floor((self.lat0 - high) / self.dlat) - 1),
            min(self.nlat - 1, math.ceil((self.lat0 - low) / self.dlat) + 1),
            max(0, math.floor((west - self.lon0) / self.dlon) - 1),
            min(self.nlon - 1, math.ceil((east - self.lon0) / self.dlon) + 1),
        )
