"""A package of weather files for the points of a GeoJSON file, as one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwx.grid import GridSpec
from gridwx.operators import export, merge, points
from gridwx.operators.aggregate import points_bounds
from gridwx.operators.select import local_subset
from gridwx.sources import vector
from gridwx.workspace import staged

#: Vertices of a feature are numbered below this, so that feature and vertex make one sequence number.
VERTICES = 1 << 20


def points_of(features: DataFrame, max_points: int | None = points.MAX_POINTS) -> DataFrame:
    """point_seq, point_id, lat, lon of the features' vertices: valid ones, the first of each place, each with an id.

    More than max_points (None: any number is allowed), or none that is valid, are an error with the validation's message.
    """
    found = vector.feature_points(features)
    found = staged(found.select((F.col("feature_seq") * VERTICES + F.col("vertex_seq")).cast("long").alias("point_seq"), "point_id", "lat", "lon"), "points")
    named = found.withColumn("point_id", F.coalesce("point_id", F.col("point_seq").cast("string")))
    report = points.validate_points(named, max_points).first()
    if not report["valid"]:
        raise ValueError(f"{report['message']}: {report['issues']}")
    return staged(points.assign_ids(points.dedup_points(points.only_valid(found))), "points")


def build(
    features: DataFrame, grid: DataFrame, met: DataFrame, elevation: DataFrame, specs: tuple[GridSpec, GridSpec, GridSpec], first: str, last: str, variables: list[str], rain_source: str = "both",
    max_points: int | None = points.MAX_POINTS,
) -> DataFrame:
    """kind (file, manifest or readme), point_seq, file_name, content of the package's files.

    features: feature_seq, feature_json. specs: of the rain grid, of the weather grid and of the elevation. Only the cells
    around the points are kept of both grids, and the merged series is written once, per place. The manifest lists the points where
    ids had to be made.
    """
    fine, coarse, ground = specs
    chosen = points_of(features, max_points)
    box = points_bounds(chosen)
    located = staged(merge.places(chosen, fine, coarse), "located")
    codes = [v for v in variables if v != "RAIN"]
    series = merge.place_series(located, local_subset(grid, box, fine), merge.canonical(local_subset(met, box, coarse)), codes, rain_source)
    series = staged(series.select(*merge.PLACE, "obs_date", *variables), "series")
    heights = points.elevation_points(chosen, elevation, ground).select("point_seq", "elev")
    sites = located.join(heights, "point_seq").join(merge.tav_amp(series, merge.PLACE), merge.PLACE)
    names = export.unique_names(export.file_names(chosen, first, last))
    files = export.file_content(series, sites, rain_source, keys=merge.PLACE).join(names, "point_seq")
    files = files.select(F.lit("file").alias("kind"), "point_seq", "file_name", "content")
    readme = export.package_summary(names, series, variables, rain_source)
    readme = readme.select(F.lit("readme"), F.lit(None).cast("long"), F.lit("README.txt"), "readme")
    made = chosen.agg(F.bool_or("id_generated").alias("made"))
    manifest = export.feature_collections(chosen.withColumn("point_seq", F.floor(F.col("point_seq") / VERTICES)))
    manifest = manifest.join(F.broadcast(made.where("made"))).select(F.lit("manifest"), F.lit(None).cast("long"), F.format_string("points_%d_point_ids.geojson", "file_no"), "collection")
    return files.union(manifest).union(readme)
