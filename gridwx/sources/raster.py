"""Daily rasters: reading, decoding, exploding to cells, validation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridwx.functions.values import percentage

RESOLUTION = 0.05
CRS = "EPSG:4326"
HIGHEST = 2000.0
#: Pixels on a side of the tiles that rasters are cut into when they are read.
TILE_SIDE = 250
TILE = (
    "path string, width int, height int, crs string, transform array<double>, nodata double, band_count int, "
    "row0 int, col0 int, tile_width int, pixel_values array<float>"
)


@dataclass
class Raster:
    """What a decoder makes of a file; pixels is a matrix, first row first."""

    pixels: np.ndarray
    crs: str | None = CRS
    transform: tuple[float, ...] = (RESOLUTION, 0.0, 0.0, 0.0, -RESOLUTION, 0.0)
    nodata: float | None = None
    band_count: int = 1


def path_to_date(path: Column) -> Column:
    """The day in a file's name, ...YYYY.MM.DD.tif; null for other names."""
    found = F.regexp_extract(path, r"(\d{4}\.\d{2}\.\d{2})\.tif$", 1)
    return F.when(found != "", F.to_date(found, "yyyy.MM.dd"))


def float32_decoder(width: int, height: int) -> Callable[[bytes], Raster]:
    """Decoder of raw little-endian float32 pixels; other formats plug in here."""

    def decode(content: bytes) -> Raster:
        pixels = np.frombuffer(content, "<f4")
        if len(pixels) != width * height:
            raise ValueError(f"{len(pixels)} pixels, expected {width * height}")
        return Raster(pixels.reshape(height, width))

    return decode


def raster_files(spark: SparkSession, path: str, glob: str = "*.tif") -> DataFrame:
    """path, content of the rasters in a folder and those below it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    return files.load(path).select("path", "content")


def read_rasters(spark: SparkSession, path: str, decode: Callable[[bytes], Raster], glob: str = "*.tif", side: int = TILE_SIDE) -> DataFrame:
    """The tiles of every raster in a folder, decoded by the executors."""
    return decode_rasters(raster_files(spark, path, glob), decode, side)


def decode_rasters(files: DataFrame, decode: Callable[[bytes], Raster], side: int = TILE_SIDE) -> DataFrame:
    """files: path, content. A row per tile of at most side x side pixels, with the place of its first pixel.

    One raster is in memory at a time, and its pixels travel as Arrow buffers. A file that cannot be decoded, whatever
    its decoder raises, gives one row without pixels, with the text of the exception as `decode_error`.
    """

    def rows(path: str, raster: Raster | None, error: str | None = None) -> pa.RecordBatch:
        schema = pa.schema(
            [("path", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("crs", pa.string()), ("transform", pa.list_(pa.float64())), ("nodata", pa.float64())]
            + [("band_count", pa.int32()), ("row0", pa.int32()), ("col0", pa.int32()), ("tile_width", pa.int32()), ("pixel_values", pa.list_(pa.float32()))]
            + [("decode_error", pa.string())]
        )
        if raster is None:
            return pa.RecordBatch.from_pylist([{"path": path, "decode_error": error}], schema)
        height, width = raster.pixels.shape
        places = [(r, c) for r in range(0, height, side) for c in range(0, width, side)]
        tiles = [raster.pixels[r : r + side, c : c + side] for r, c in places]
        offsets = np.concatenate(([0], np.cumsum([t.size for t in tiles]))).astype(np.int32)
        flat = np.concatenate([t.ravel() for t in tiles]) if tiles else np.empty(0)
        n = len(places)
        same = [path, width, height, raster.crs, list(raster.transform), raster.nodata, raster.band_count]
        columns = [pa.array([x] * n, f.type) for x, f in zip(same, schema)]
        columns += [pa.array([r for r, _ in places], pa.int32()), pa.array([c for _, c in places], pa.int32()), pa.array([t.shape[1] for t in tiles], pa.int32())]
        columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.float32, copy=False))))
        columns.append(pa.nulls(n, pa.string()))
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                try:
                    found = rows(path.as_py(), decode(content.as_py()))
                except Exception as error:  # a plugged-in decoder raises what it likes; the file is an outcome of its own
                    found = rows(path.as_py(), None, f"{type(error).__name__}: {error}")
                yield found

    decoded = files.select("path", "content").mapInArrow(run, f"{TILE}, decode_error string")
    return decoded.withColumn("obs_date", path_to_date(F.col("path"))).select("obs_date", *decoded.columns)


def explode_cells(tiles: DataFrame, transform: list[float] | None = None) -> DataFrame:
    """Cells of each raster or tile: pixel row and column, centre coordinates by the affine transform, value."""
    t = F.array(*[F.lit(float(x)) for x in transform]) if transform else F.col("transform")
    tiled = "row0" in tiles.columns
    origin = [F.col("row0"), F.col("col0"), F.col("tile_width")] if tiled else [F.lit(0), F.lit(0), F.col("width")]
    cells = tiles.select("obs_date", t.alias("t"), *[c.alias(n) for c, n in zip(origin, ("r0", "c0", "across"))], F.posexplode("pixel_values").alias("pos", "value"))
    row, col = F.expr("r0 + CAST(pos DIV across AS INT)"), F.expr("c0 + CAST(pos % across AS INT)")
    lat = F.get("t", F.lit(5)) + (row + 0.5) * F.get("t", F.lit(4))
    lon = F.get("t", F.lit(2)) + (col + 0.5) * F.get("t", F.lit(0))
    return cells.select("obs_date", row.alias("lat_idx"), col.alias("lon_idx"), lat.alias("latitude"), lon.alias("longitude"), "value")


def valid_pixel(value: Column, nodata: Column) -> Column:
    """The value unless it is the nodata value, -9999 or NaN."""
    bad = F.isnan(value) | (value == -9999.0) | F.coalesce(value == nodata, F.lit(False))
    return F.when(~bad, value)


def raster_facts(tiles: DataFrame, nodata: float | None = None) -> DataFrame:
    """A row per raster: its file (where tiles have a path), day, head, and the counts and range of its pixels."""
    v = valid_pixel(F.col("v").cast("double"), F.lit(nodata).cast("double"))
    head = [c for c in ("path", "obs_date", "width", "height", "crs", "transform", "band_count", "decode_error") if c in tiles.columns]
    cells = tiles.select(*head, F.explode_outer("pixel_values").alias("v"))
    return cells.groupBy(*head).agg(
        F.count(v).alias("valid_pixels"), F.count("v").alias("total_pixels"), F.min(v).alias("min_value"), F.max(v).alias("max_value"), F.count_if(v < 0).alias("negatives")
    )


def check_rasters(
    facts: DataFrame, reference: dict | None = None, expected_crs: str | None = None, resolution: float | None = None, same_transform: bool = False
) -> DataFrame:
    """raster_facts() with errors (array of texts) and is_valid.

    Each raster must have one band, valid pixels and sane values, and, where they are given, the expected reference system
    and resolution. Its size and reference system must be those of the reference (width, height, crs, transform: a table's
    own), or else of the first raster that passes the checks before; with same_transform its place too. Of several files
    of a day the first valid one by path is valid.
    """
    for name, kind in (("path", "string"), ("transform", "array<double>"), ("decode_error", "string")):
        if name not in facts.columns:
            facts = facts.withColumn(name, F.lit(None).cast(kind))

    def off(place: int, axis: str) -> tuple:
        step = F.abs(F.get("transform", F.lit(place)))
        text = F.concat(F.lit(f"Unexpected {axis} resolution: "), step.cast("string"), F.lit(f", expected {resolution}"))
        return F.abs(step - resolution) > 1e-5 * abs(resolution), text

    fixed = [(F.col("band_count") != 1, F.lit("Expected single band"))]
    if expected_crs is not None:
        text = F.concat(F.lit("Unexpected CRS: "), F.coalesce("crs", F.lit("None")), F.lit(f", expected {expected_crs}"))
        fixed.append((~F.col("crs").eqNullSafe(F.lit(expected_crs)), text))
    if resolution is not None:
        fixed += [off(0, "X"), off(4, "Y")]
    fixed.append((F.col("path").isNotNull() & F.col("obs_date").isNull(), F.lit("No day in the file's name")))
    fixed += [
        (F.col("valid_pixels") == 0, F.lit("No valid data pixels found (all NoData or NaN)")),
        (F.col("negatives") > 0, F.concat(F.lit("Found "), F.col("negatives").cast("string"), F.lit(" negative precipitation values"))),
        (F.col("max_value") > HIGHEST, F.lit("Unrealistic max precipitation")),
    ]

    def texts(checks: list[tuple]):
        return F.array_compact(F.array(*[F.when(bad, text) for bad, text in checks]))

    unread = F.array(F.concat(F.lit("File cannot be decoded"), F.coalesce(F.concat(F.lit(": "), "decode_error"), F.lit(""))))
    found = facts.withColumn("errors", F.when(F.col("width").isNull(), unread).otherwise(texts(fixed)))
    grid = F.struct("width", "height", "crs", "transform")
    if reference is None:
        first = found.where(F.size("errors") == 0).agg(F.min_by(grid, F.struct("obs_date", "path")).alias("ref"))
        found = found.join(F.broadcast(first))
    else:
        parts = [F.lit(reference[k]).cast(t).alias(k) for k, t in (("width", "int"), ("height", "int"), ("crs", "string"))]
        parts.append((F.array(*[F.lit(float(x)) for x in reference["transform"]]) if reference.get("transform") else F.lit(None).cast("array<double>")).alias("transform"))
        found = found.withColumn("ref", F.struct(*parts))
    unlike = [(F.col("width") != F.col("ref.width"), F.lit("Width mismatch")), (F.col("height") != F.col("ref.height"), F.lit("Height mismatch"))]
    unlike.append((F.col("ref").isNotNull() & ~F.col("crs").eqNullSafe(F.col("ref.crs")), F.lit("CRS mismatch")))
    if same_transform:
        unlike.append((F.col("ref").isNotNull() & ~F.col("transform").eqNullSafe(F.col("ref.transform")), F.lit("Transform mismatch")))
    found = found.withColumn("errors", F.when(F.col("width").isNull(), F.col("errors")).otherwise(F.concat("errors", texts(unlike))))
    # one file a day
    order = Window.partitionBy("obs_date").orderBy(F.size("errors") > 0, "path")
    again = (F.row_number().over(order) > 1) & (F.size("errors") == 0) & F.col("path").isNotNull()
    found = found.withColumn("again", again)
    errors = F.when(F.col("again"), F.array(F.lit("Another file of this day"))).otherwise(F.col("errors"))
    return found.withColumn("errors", errors).withColumn("is_valid", F.size("errors") == 0).drop("again", "ref")


def validate_rasters(tiles: DataFrame, nodata: float | None = None, same_transform: bool = False, **checks) -> DataFrame:
    """Per raster: counts, range, list of errors, is_valid, by check_rasters(). A file that could not be decoded has no valid
    pixels."""
    found = check_rasters(raster_facts(tiles, nodata), same_transform=same_transform, **checks)
    pct = percentage(F.col("valid_pixels"), F.col("total_pixels")).alias("valid_pct")
    return found.select(*(["path"] if "path" in tiles.columns else []), "obs_date", "valid_pixels", "total_pixels", pct, "min_value", "max_value", "errors", "is_valid")


def validate_day(grid: DataFrame, value: str, threshold: float = 80.0) -> DataFrame:
    """Per day: has data, no negatives, maximum below 2000 (here 2000 itself fails), mean, coverage, complete, all passed."""
    v = F.when(F.col(value) != -9999.0, F.col(value))
    found = grid.groupBy("obs_date").agg(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean_value"), F.count(F.lit(1)).alias("cells"))
    has, negative_free, sane = F.col("n") > 0, F.coalesce(F.col("lo") >= 0, F.lit(True)), F.coalesce(F.col("hi") < HIGHEST, F.lit(False))
    pct = percentage(F.col("n"), F.col("cells"))
    return found.select(
        "obs_date", has.alias("has_data"), negative_free.alias("no_negatives"), sane.alias("reasonable_max"), "mean_value", pct.alias("valid_pct"), (pct >= threshold).alias("complete"), (has & negative_free & sane).alias("all_passed")
    )
