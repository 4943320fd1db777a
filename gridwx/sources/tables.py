"""Reading and writing of the engine's tables, and their metadata."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwx.sources import daylog

GRID = "lat_idx INT, lon_idx INT, latitude DOUBLE, longitude DOUBLE, obs_date DATE, precipitation FLOAT"
TILE_CELLS = 250
# Attributes that a metadata file may set, with their defaults.
ATTRIBUTES = {
    "title": "Daily precipitation",
    "institution": "Unknown",
    "source": "Daily rasters",
    "references": "",
    "comment": "",
}


def scan_grid(spark: SparkSession, path: str, schema: str = GRID) -> DataFrame:
    """Lazy; the explicit schema saves the inference pass."""
    return spark.read.schema(schema).parquet(path)


def clean_elevation(elevation: DataFrame, lowest: float = -430.0, highest: float = 9000.0) -> DataFrame:
    """Null for NaN, infinities and values outside the range."""
    good = (F.col("elev") >= lowest) & (F.col("elev") <= highest) & ~F.isnan("elev")
    return elevation.withColumn("elev", F.when(good, F.col("elev")))


def create_table(df: DataFrame, path: str) -> None:
    """First write, one partition per day; an existing table is an error."""
    daylog.create(df.sparkSession, path, df)


def append_new_days(existing: DataFrame, incoming: DataFrame, allow_duplicate: bool = False) -> DataFrame:
    """The rows that an append adds: those of days that the table (or its day log) lacks, or all."""
    return incoming if allow_duplicate else incoming.join(existing.select("obs_date").distinct(), "obs_date", "left_anti")


def append(spark: SparkSession, incoming: DataFrame, path: str, allow_duplicate: bool = False) -> int:
    """Appends whole days; a repeated run adds nothing, an allowed duplicate replaces its day. Returns the table's days, which
    its log tells."""
    daylog.append(spark, path, incoming, allow_duplicate)
    return daylog.days(spark, path).count()


def _interleaved(x: Column, y: Column, bits: int = 16) -> Column:
    """Place on a space-filling (Z-order) curve: the bits of two indexes in turn, so that near cells come near each other."""
    found = F.lit(0).cast("long")
    for i in range(bits):
        for place, index in ((2 * i + 1, x), (2 * i, y)):
            found = found + F.shiftleft(F.shiftright(index.cast("long"), i).bitwiseAND(F.lit(1)), place)
    return found


def compact(spark: SparkSession, staging: str, path: str, tile: int = TILE_CELLS, page_rows: int = 20_000) -> None:
    """A table with a day log into the layout for reading by place: a folder per year and tile of tile x tile cells, in it the
    cells along a space-filling curve, each cell's days in order, in pages of page_rows rows whose ranges readers skip by."""
    rows = daylog.read(spark, staging).withColumn("year", F.year("obs_date"))
    rows = rows.withColumn("tile_lat", F.expr(f"lat_idx DIV {tile}").cast("int")).withColumn("tile_lon", F.expr(f"lon_idx DIV {tile}").cast("int"))
    keys = ["year", "tile_lat", "tile_lon"]
    curve = _interleaved(F.col("lat_idx") % tile, F.col("lon_idx") % tile)
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, curve, "obs_date")
    rows.write.partitionBy(*keys).option("parquet.page.row.count.limit", page_rows).mode("overwrite").parquet(path)
    spark.createDataFrame([(tile,)], "tile int").coalesce(1).write.mode("overwrite").json(f"{path}/_layout")


def read_tiles(spark: SparkSession, path: str, rows: tuple[int, int], columns: tuple[int, int], first: str | None = None, last: str | None = None) -> DataFrame:
    """Cells of a compacted table with lat_idx and lon_idx in these (inclusive) ranges, on days from first to last.

    The tiles and years that a request touches are a condition on folders, its cells and days one on the pages' ranges, so
    that a scan reads little more than was asked for.
    """
    tile = spark.read.schema("tile int").json(f"{path}/_layout").first()["tile"]
    found = spark.read.parquet(path)
    for name, (lo, hi) in (("lat", rows), ("lon", columns)):
        found = found.where(F.col(f"tile_{name}").between(lo // tile, hi // tile) & F.col(f"{name}_idx").between(lo, hi))
    for day, low in ((first, True), (last, False)):
        if day is not None:
            bound, of = F.lit(day).cast("date"), int(day[:4])
            found = found.where((F.col("year") >= of) & (F.col("obs_date") >= bound) if low else (F.col("year") <= of) & (F.col("obs_date") <= bound))
    return found.drop("year", "tile_lat", "tile_lon")


def grid_metadata(grid: DataFrame) -> DataFrame:
    """Days, extents and resolution (the smallest step between latitudes) in one row."""
    lats = grid.select("latitude").distinct()
    row = grid.agg(
        F.min("obs_date").alias("first_day"), F.max("obs_date").alias("last_day"), F.count_distinct("obs_date").alias("n_days"), F.min("latitude").alias("lat_min"), F.max("latitude").alias("lat_max"),
        F.min("longitude").alias("lon_min"), F.max("longitude").alias("lon_max"),
    )
    # a few thousand latitudes at most: neighbours by their sorted list
    steps = lats.agg(F.array_sort(F.collect_list("latitude")).alias("a")).select(
        F.array_min(F.zip_with(F.slice("a", F.lit(2), F.greatest(F.size("a") - 1, F.lit(0))), F.slice("a", F.lit(1), F.greatest(F.size("a") - 1, F.lit(0))), lambda x, y: x - y)).alias("resolution")
    )
    return row.join(F.broadcast(steps))


def attributes(meta_json: DataFrame, defaults: dict[str, str] | None = None) -> DataFrame:
    """attrs map: the five known keys of each metadata JSON (column value), others ignored, defaults for what is missing."""
    defaults = defaults or ATTRIBUTES
    base = F.create_map(*[F.lit(x) for pair in defaults.items() for x in pair])
    given = F.coalesce(F.from_json("value", "map<string,string>"), F.create_map().cast("map<string,string>"))
    known = F.map_filter(given, lambda k, v: k.isin(*defaults) & v.isNotNull())
    merged = F.map_from_entries(F.transform(F.map_entries(base), lambda e: F.struct(e["key"].alias("key"), F.coalesce(F.element_at(known, e["key"]), e["value"]).alias("value"))))
    return meta_json.withColumn("attrs", merged)


def dataset_meta(grid: DataFrame, defaults: dict[str, str] | None = None) -> DataFrame:
    """key, value rows: attributes, then extents and the latest day."""
    ends = grid.agg(F.min("latitude").alias("a"), F.max("latitude").alias("b"), F.min("longitude").alias("c"), F.max("longitude").alias("d"), F.min("obs_date").alias("e"), F.max("obs_date").alias("f"))
    names = ["geospatial_lat_min", "geospatial_lat_max", "geospatial_lon_min", "geospatial_lon_max", "time_coverage_start", "time_coverage_end"]
    pairs = [F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in (defaults or ATTRIBUTES).items()]
    pairs += [F.struct(F.lit(n).alias("key"), (F.format_string("%.4f", c) if c in "abcd" else F.col(c).cast("string")).alias("value")) for n, c in zip(names, "abcdef")]
    return ends.select(F.explode(F.array(*pairs)).alias("p")).select("p.key", "p.value")


def finalise(spark: SparkSession, path: str, meta_json: DataFrame, defaults: dict[str, str] | None = None) -> DataFrame:
    """Store a table's metadata after a load, and return it as key, value rows: its days and extents anew, the attributes of the
    last row of meta_json (value: a JSON text; none: defaults) over the defaults, when that was, and that the table is complete."""
    defaults = defaults or ATTRIBUTES
    given = attributes(meta_json, defaults).select("attrs").tail(1)
    # one day has all cells, so the extents need no scan of the others; the days are those of the log
    span = daylog.days(spark, path).agg(F.min("obs_date"), F.max("obs_date")).first()
    rows = dataset_meta(daylog.read(spark, path, str(span[1]), str(span[1])), dict(given[0]["attrs"]) if given else defaults).collect() if span[1] else []
    stored = {r["key"]: r["value"] for r in rows} | {"time_coverage_start": str(span[0]), "time_coverage_end": str(span[1])}
    stored |= {"date_modified": datetime.datetime.now(datetime.timezone.utc).isoformat(timespec="seconds"), "bootstrap_complete": "true"}
    daylog.put(spark, path, stored)
    return spark.createDataFrame(sorted(stored.items()), "key string, value string")


def stored_metadata(spark: SparkSession, path: str) -> DataFrame:
    """key, value rows of what is stored with a table."""
    return spark.createDataFrame(sorted(daylog.properties(spark, path).items()), "key string, value string")


def append_audit(events: DataFrame, path: str) -> None:
    """Append rows (event, obs_date and what else there is) to the audit table, a partition per kind of event."""
    events.write.partitionBy("event").mode("append").parquet(path)


def table_size(spark: SparkSession, path: str) -> DataFrame:
    """Stored megabytes of a path, from the files' listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.count(F.lit(1)).alias("files"), (F.sum("length") / 1048576).alias("megabytes"))


def write_csv(df: DataFrame, path: str) -> None:
    """One file with a header, for results that are small."""
    df.coalesce(1).write.option("header", True).mode("overwrite").csv(path)


def audit_summary(events: DataFrame) -> DataFrame:
    """Rows, first and last day per kind of event."""
    return events.groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.min("obs_date").alias("first_day"), F.max("obs_date").alias("last_day"))
