"""GeoJSON features to points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwx.operators.ordered import running_sum

# Names of an id property, in the order in which they are looked for.
ID_NAMES = ["id", "point_id", "pid", "cell_id", "id_column", "cellid", "pointid"]
FEATURE = "struct<properties: map<string,string>, geometry: string>"


def read_features(spark: SparkSession, path: str, by_line: bool = False) -> DataFrame:
    """feature_seq, feature_json of the FeatureCollections in a file or folder, or of one feature per line.

    Features are numbered from 0 without gaps, by file name and place in the file, so numbers are unique over a folder; lines
    in the order in which they are read.
    """
    if by_line:
        lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("k"), F.col("value").alias("feature_json"), F.lit(1).cast("long").alias("n"))
        return running_sum(lines, [], ["k"], "n", "feature_seq").select("feature_seq", "feature_json")
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", "struct<features: array<string>>")["features"].alias("items"))
    counts = whole.select("file", F.greatest(F.size(F.coalesce("items", F.array())), F.lit(0)).cast("long").alias("n"))
    first = running_sum(counts, [], ["file"], "n", "first").select("file", "first")
    rows = whole.join(first, "file").select("first", F.posexplode("items").alias("place", "feature_json"))
    return rows.select((F.col("first") + F.col("place")).alias("feature_seq"), "feature_json")


def vertices(geometry: Column) -> Column:
    """[lon, lat] pairs: points, lines and exterior rings in order; empty and other geometries give none."""
    kind = F.get_json_object(geometry, "$.type")
    raw = F.get_json_object(geometry, "$.coordinates")
    one = F.array(F.from_json(raw, "array<double>"))
    line = F.from_json(raw, "array<array<double>>")
    rings = F.from_json(raw, "array<array<array<double>>>")
    polygons = F.from_json(raw, "array<array<array<array<double>>>>")
    return (
        F.when(kind == "Point", one)
        .when(kind.isin("MultiPoint", "LineString"), line)
        .when(kind == "MultiLineString", F.flatten(rings))
        .when(kind == "Polygon", F.get(rings, F.lit(0)))
        .when(kind == "MultiPolygon", F.flatten(F.transform(polygons, lambda p: F.get(p, F.lit(0)))))
    )


def feature_points(features: DataFrame) -> DataFrame:
    """feature_seq, vertex_seq, lon, lat, point_id. The first id name that any feature has is the file's id column; blanks are missing."""
    parsed = features.select("feature_seq", F.from_json("feature_json", "properties map<string,string>, geometry string").alias("f"))
    parsed = parsed.select("feature_seq", F.transform_keys("f.properties", lambda k, v: F.lower(k)).alias("props"), vertices(F.col("f.geometry")).alias("vs"))
    has = parsed.agg(*[F.bool_or(F.coalesce(F.map_contains_key("props", F.lit(n)), F.lit(False))).alias(f"h{i}") for i, n in enumerate(ID_NAMES)])
    name = F.coalesce(*[F.when(F.col(f"h{i}"), F.lit(n)) for i, n in enumerate(ID_NAMES)])
    parsed = parsed.join(F.broadcast(has.select(name.alias("id_name"))))
    ident = F.trim(F.element_at("props", F.coalesce("id_name", F.lit(""))))
    rows = parsed.select("feature_seq", F.when(ident != "", ident).alias("point_id"), F.posexplode("vs").alias("vertex_seq", "v"))
    return rows.select("feature_seq", "vertex_seq", F.get("v", F.lit(0)).alias("lon"), F.get("v", F.lit(1)).alias("lat"), "point_id").where("lon IS NOT NULL AND lat IS NOT NULL")
