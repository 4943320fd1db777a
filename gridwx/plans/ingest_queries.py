"""Queries of ingestion: rasters, validation, appends, summaries, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwx.operators import state as T
from gridwx.plans.registry import query
from gridwx.sources import daylog, kept, raster, tables
from gridwx.streaming import ingest
from gridwx.workspace import scratch

TRANSFORM = [0.05, 0.0, 30.0, 0.0, -0.05, 0.25]
ABS_SQL = "SELECT obs_date, width, height, crs, band_count, list_transform(pixel_values, lambda x: abs(x)) AS pixel_values FROM fx_raster_tile"


@query("manifest", "SELECT path, CAST(strptime(regexp_extract(path, '([0-9]{4}\\.[0-9]{2}\\.[0-9]{2})\\.tif$', 1), '%Y.%m.%d') AS DATE) AS obs_date FROM fx_manifest")
def path_to_date(spark, sf_dir, manifest):
    return manifest.select("path", raster.path_to_date(F.col("path")).alias("obs_date"))


@query("raster_tile", ", x AS (SELECT obs_date, pixel_values, unnest(generate_series(0, 63)) AS p FROM fx_raster_tile) SELECT obs_date, CAST(p // 8 AS INTEGER) AS lat_idx, CAST(p % 8 AS INTEGER) AS lon_idx, 0.25e0 + (p // 8 + 0.5e0) * -0.05e0 AS latitude, 30e0 + (p % 8 + 0.5e0) * 0.05e0 AS longitude, pixel_values[p + 1] AS value FROM x")
def raster_explode(spark, sf_dir, tiles):
    return raster.explode_cells(tiles, TRANSFORM)


def _files(tiles):
    """Rasters as files: a head of reference system, bands, width and height, then raw float32 pixels."""

    def packed(batches):
        import numpy as np

        for batch in batches:
            heads = batch[["crs", "band_count", "width", "height"]].itertuples(index=False)
            heads = [np.array([int(h.crs.removeprefix("EPSG:")), h.band_count, h.width, h.height], "<i4").tobytes() for h in heads]
            yield batch[["path"]].assign(content=[h + np.asarray(v, "<f4").tobytes() for h, v in zip(heads, batch["pixel_values"])])

    path = F.concat(F.lit("rasters/raster.v3."), F.date_format("obs_date", "yyyy.MM.dd"), F.lit(".tif"))
    return tiles.select(path.alias("path"), "crs", "band_count", "width", "height", "pixel_values").mapInPandas(packed, "path string, content binary")


def _decode(content):
    import numpy as np

    crs, bands, width, height = np.frombuffer(content, "<i4", 4).tolist()
    if bands < 0:
        raise OSError("bad block")
    pixels = np.frombuffer(content, "<f4", offset=16).reshape(height, width)
    return raster.Raster(pixels, f"EPSG:{crs}", tuple(TRANSFORM), None, bands)


@query("raster_tile", """, x AS (SELECT obs_date, crs, band_count, pixel_values, unnest(generate_series(0, 63)) AS p FROM fx_raster_tile)
    SELECT obs_date, CAST(8 AS INTEGER) AS width, CAST(8 AS INTEGER) AS height, crs, CAST(band_count AS INTEGER) AS band_count, CAST(p // 8 AS INTEGER) AS lat_idx, CAST(p % 8 AS INTEGER) AS lon_idx, pixel_values[p + 1] AS value FROM x""")
def raster_decode(spark, sf_dir, tiles):
    """The content of raster files, decoded by the executors into tiles of three pixels on a side."""
    decoded = raster.decode_rasters(_files(tiles), _decode, 3)
    cells = raster.explode_cells(decoded).select("obs_date", "lat_idx", "lon_idx", "value")
    heads = decoded.where("row0 = 0 AND col0 = 0").select("obs_date", "width", "height", "crs", "band_count")
    return heads.join(cells, "obs_date")


#: Rasters that do not belong to the table: the first day's is in another reference system; the 13th of each month has
#: negative values, the 17th another size, the 19th raises in the decoder, the 21st has two files.
MIXED = """, t AS (SELECT obs_date, band_count, day(obs_date) AS dd, CASE WHEN obs_date = DATE '2024-01-01' THEN 'EPSG:4269' ELSE crs END AS crs,
      CASE WHEN day(obs_date) = 13 THEN pixel_values ELSE list_transform(pixel_values, lambda x: abs(x)) END AS pixel_values FROM fx_raster_tile),
    e AS (SELECT *, CASE WHEN dd = 19 THEN ['File cannot be decoded: OSError: bad block'] ELSE list_filter([
      CASE WHEN crs <> 'EPSG:4326' THEN 'CRS mismatch' END, CASE WHEN band_count <> 1 THEN 'Expected single band' END,
      CASE WHEN list_min(pixel_values) < 0 THEN 'Found ' || CAST(len(list_filter(pixel_values, lambda x: x < 0)) AS VARCHAR) || ' negative precipitation values' END,
      CASE WHEN dd = 17 THEN 'Height mismatch' END, CASE WHEN crs <> 'EPSG:4326' THEN 'Unexpected CRS: ' || crs || ', expected EPSG:4326' END,
      CASE WHEN dd = 17 THEN 'Width mismatch' END], lambda s: s IS NOT NULL) END AS errs FROM t),
    f AS (SELECT obs_date, 'rasters/raster.v3.' || strftime(obs_date, '%Y.%m.%d') || '.tif' AS path, errs FROM e
      UNION ALL SELECT obs_date, 'rasters/second/raster.v3.' || strftime(obs_date, '%Y.%m.%d') || '.tif', CASE WHEN len(errs) = 0 THEN ['Another file of this day'] ELSE errs END FROM e WHERE dd = 21)"""


def _mixed_files(tiles):
    """The rasters' files, with some that do not belong to the table."""
    dd = F.dayofmonth("obs_date")
    tiles = tiles.withColumn("pixel_values", F.when(dd == 13, F.col("pixel_values")).otherwise(F.transform("pixel_values", F.abs)))
    tiles = tiles.withColumn("crs", F.when(F.col("obs_date") == F.lit("2024-01-01").cast("date"), "EPSG:4269").otherwise(F.col("crs")))
    tiles = tiles.withColumns({"width": F.when(dd == 17, 16).otherwise(8), "height": F.when(dd == 17, 4).otherwise(8), "band_count": F.when(dd == 19, -1).otherwise(F.col("band_count"))})
    files = _files(tiles)
    second = files.where(F.dayofmonth(raster.path_to_date(F.col("path"))) == 21)
    return files.unionByName(second.withColumn("path", F.regexp_replace("path", "^rasters/", "rasters/second/")))


@query(
    "raster_tile",
    MIXED + """ SELECT obs_date, path, CASE WHEN len(errs) = 0 THEN 'ok' ELSE 'failed' END AS outcome, array_to_string(errs, '; ') AS errors,
    CAST(64 * max(CAST(len(errs) = 0 AS INTEGER)) OVER (PARTITION BY obs_date) AS INTEGER) AS n_cells FROM f""",
)
def bootstrap_outcomes(spark, sf_dir, tiles):
    """A table made of raster files: each file's outcome, and the cells that the table has of its day."""
    table = scratch(spark, "bootstrap")
    found = ingest.bootstrap_run(spark, _mixed_files(tiles), _decode, table)
    cells = daylog.read(spark, table).groupBy("obs_date").agg(F.count("precipitation").alias("n"))
    errors = F.array_join(F.array_sort("errors"), "; ")
    return found.join(cells, "obs_date", "left").select("obs_date", "path", "outcome", errors.alias("errors"), F.coalesce("n", F.lit(0)).cast("int").alias("n_cells"))


@query(
    "raster_tile",
    MIXED + """, d AS (SELECT 1 AS run, CAST(unnest(generate_series(DATE '2024-04-01', DATE '2024-04-30', INTERVAL 1 DAY)) AS DATE) AS obs_date
    UNION ALL SELECT 2, unnest([DATE '2024-05-01', DATE '2024-05-02']) UNION ALL SELECT 3, CAST(unnest(generate_series(DATE '2024-03-25', DATE '2024-04-23', INTERVAL 1 DAY)) AS DATE)),
    g AS (SELECT obs_date, bool_or(len(errs) = 0) AS good FROM f GROUP BY 1)
    SELECT CAST(run AS INTEGER) AS run, obs_date, CASE WHEN obs_date = DATE '2024-05-02' THEN 'missing' WHEN run = 3 AND good THEN 'skipped' WHEN len(errs) = 0 THEN 'ok' ELSE 'failed' END AS outcome,
    CASE WHEN obs_date <> DATE '2024-05-02' AND NOT (run = 3 AND good) THEN path END AS path
    FROM d JOIN f USING (obs_date) JOIN g USING (obs_date) WHERE NOT (run = 3 AND good AND path LIKE '%second%')""",
)
def incremental_outcomes(spark, sf_dir, tiles):
    """After a bootstrap of three months: a run of thirty days, one that ends at a missing file, and a forced one over days
    that the table has, but for the rejected ones."""
    files = _mixed_files(tiles).withColumn("day", raster.path_to_date(F.col("path"))).where("day <> DATE'2024-05-02'")
    table = scratch(spark, "incremental")
    ingest.bootstrap_run(spark, files.where("day < DATE'2024-04-01'"), _decode, table)
    runs = []
    for run, forced in ((1, None), (2, None), (3, "2024-03-25")):
        done = ingest.incremental_run(spark, files, _decode, table, forced)
        runs.append(done.select(F.lit(run).alias("run"), "obs_date", "outcome", "path"))
    return runs[0].unionByName(runs[1]).unionByName(runs[2])


@query(
    "raster_tile",
    MIXED + """, ends AS (SELECT min(obs_date) AS a, max(obs_date) AS b FROM f WHERE len(errs) = 0)
    SELECT unnest(['bootstrap_complete', 'comment', 'geospatial_lat_max', 'geospatial_lat_min', 'geospatial_lon_max', 'geospatial_lon_min', 'institution', 'references', 'source', 'time_coverage_end', 'time_coverage_start', 'title']) AS key,
    unnest(['true', '', '0.2250', '-0.1250', '30.3750', '30.0250', 'Unknown', '', 'Daily rasters', CAST(b AS VARCHAR), CAST(a AS VARCHAR), 'Daily precipitation']) AS value FROM ends""",
)
def stored_metadata(spark, sf_dir, tiles):
    """What a bootstrap leaves with its table, but for the time of the load, the schema and the raster's own grid."""
    table = scratch(spark, "bootstrap")
    ingest.bootstrap_run(spark, _mixed_files(tiles), _decode, table)
    return tables.stored_metadata(spark, table).where("key NOT IN ('date_modified', 'schema', 'grid')")


@query("grid_daily", "SELECT obs_date, count(*) AS cells, count(*) AS n_read, round(sum(precipitation), 4) AS total FROM fx_grid_daily GROUP BY 1")
def day_log(spark, sf_dir, grid):
    """A table of days made, appended to, and appended to once more: its log, and what a read by the log gives."""
    path, rows = scratch(spark, "days"), grid.repartition("obs_date")
    daylog.create(spark, path, rows.where("obs_date < DATE'1995-01-01'"))
    for _ in range(2):
        daylog.append(spark, path, rows)
    found = daylog.read(spark, path).groupBy("obs_date").agg(F.count(F.lit(1)).alias("n_read"), F.round(F.sum("precipitation"), 4).alias("total"))
    return daylog.days(spark, path).select("obs_date", "cells").join(found, "obs_date")


#: The first day's raster is in another reference system.
CHECKED = """, h AS (SELECT obs_date, CASE WHEN obs_date = DATE '2024-01-01' THEN 'EPSG:4269' ELSE crs END AS crs, band_count, pixel_values FROM fx_raster_tile),
    f AS (SELECT min_by(crs, obs_date) AS crs FROM h WHERE band_count = 1 AND crs = 'EPSG:4326' AND len(list_filter(pixel_values, lambda p: p < 0)) = 0),
    x AS (SELECT obs_date, crs, band_count, unnest(pixel_values) AS v FROM h),
    a AS (SELECT obs_date, x.crs, band_count, count(*) FILTER (v <> -9999) AS valid_pixels, count(*) AS total_pixels, min(CAST(v AS DOUBLE)) AS min_value, max(CAST(v AS DOUBLE)) AS max_value, count(*) FILTER (v < 0) AS negatives FROM x GROUP BY ALL),
    e AS (SELECT *, list_filter([CASE WHEN crs <> (SELECT crs FROM f) THEN 'CRS mismatch' END, CASE WHEN band_count <> 1 THEN 'Expected single band' END, CASE WHEN negatives > 0 THEN 'Found ' || CAST(negatives AS VARCHAR) || ' negative precipitation values' END, CASE WHEN crs <> 'EPSG:4326' THEN 'Unexpected CRS: ' || crs || ', expected EPSG:4326' END], lambda s: s IS NOT NULL) AS errors FROM a)"""


@query("raster_tile", CHECKED + " SELECT obs_date, valid_pixels, total_pixels, 100e0 * valid_pixels / total_pixels AS valid_pct, min_value, max_value, array_to_string(errors, '; ') AS errors, len(errors) = 0 AS is_valid FROM e")
def raster_validate(spark, sf_dir, tiles):
    """Against the expected reference system, and the first raster that has it and is sound otherwise."""
    crs = F.when(F.col("obs_date") == F.lit("2024-01-01").cast("date"), "EPSG:4269").otherwise(F.col("crs"))
    found = raster.validate_rasters(tiles.withColumn("crs", crs), expected_crs=raster.CRS)
    return found.withColumn("errors", F.array_join(F.array_sort("errors"), "; "))


@query("grid_daily", """, a AS (SELECT obs_date, count(*) FILTER (raw_value <> -9999) AS n, min(raw_value) FILTER (raw_value <> -9999) AS lo, max(raw_value) FILTER (raw_value <> -9999) AS hi, avg(raw_value) FILTER (raw_value <> -9999) AS m, count(*) AS c FROM fx_grid_daily GROUP BY obs_date)
    SELECT obs_date, n > 0 AS has_data, coalesce(lo >= 0, true) AS no_negatives, coalesce(hi < 2000, false) AS reasonable_max, round(m, 4) AS mean_value, round(100e0 * n / c, 4) AS valid_pct, 100e0 * n / c >= 80 AS complete, n > 0 AND coalesce(lo >= 0, true) AND coalesce(hi < 2000, false) AS all_passed FROM a""")
def validate_day(spark, sf_dir, grid):
    return raster.validate_day(grid, "raw_value").withColumns({c: F.round(c, 4) for c in ("mean_value", "valid_pct")})


@query("grid_daily", "SELECT cell_id, obs_date, precipitation FROM fx_grid_daily WHERE obs_date > DATE '2001-01-01'")
def idempotent_append(spark, sf_dir, grid):
    """What a second load adds to a table that ends with 2000: the later days alone."""
    existing = grid.where("obs_date <= DATE'2001-01-01'")
    return tables.append_new_days(existing, grid).select("cell_id", "obs_date", "precipitation")


def _kept(spark, grid):
    """Monthly state kept beside a table of days that was made, and appended to in the middle of a month."""
    path, rows = scratch(spark, "kept"), grid.repartition("obs_date")
    daylog.create(spark, f"{path}/days", rows.where("obs_date <= DATE'1996-04-10'"))
    kept.refresh(spark, f"{path}/days", f"{path}/months")
    daylog.append(spark, f"{path}/days", rows)
    for _ in range(2):
        kept.refresh(spark, f"{path}/days", f"{path}/months")
    return f"{path}/months"


@query(
    "grid_daily",
    """SELECT lat_idx, lon_idx, last_day(obs_date) AS bin, count(precipitation) AS n, round(avg(precipitation), 4) AS mean, round(stddev_pop(precipitation), 4) AS std, min(precipitation) AS low, max(precipitation) AS high
    FROM fx_grid_daily WHERE precipitation IS NOT NULL GROUP BY 1, 2, 3""",
)
def kept_monthly(spark, sf_dir, grid):
    """Monthly statistics from kept state equal a full count."""
    found = kept.monthly(spark, _kept(spark, grid))
    return found.select("lat_idx", "lon_idx", "bin", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "low", "high")


@query("grid_daily", "SELECT lat_idx, lon_idx, CAST(month(obs_date) AS INTEGER) AS month, round(avg(precipitation), 4) AS mean FROM fx_grid_daily WHERE precipitation IS NOT NULL GROUP BY ALL")
def kept_climatology(spark, sf_dir, grid):
    return kept.climatology(spark, _kept(spark, grid)).withColumn("mean", F.round("mean", 4))


def _compacted(spark, grid):
    """The grid stored by place: tiles of four cells on a side, so that it has several."""
    path = scratch(spark, "tiles")
    daylog.create(spark, f"{path}/days", grid.repartition("obs_date"))
    tables.compact(spark, f"{path}/days", f"{path}/tiles", tile=4, page_rows=500)
    return f"{path}/tiles"


@query("grid_daily", "SELECT lat_idx, lon_idx, obs_date, precipitation FROM fx_grid_daily WHERE lat_idx BETWEEN 3 AND 5 AND lon_idx BETWEEN 1 AND 3 AND obs_date BETWEEN DATE '1995-06-01' AND DATE '1997-02-01'")
def stored_box(spark, sf_dir, grid):
    """A box and a range of days of a table stored by place; it touches two rows of tiles and three years."""
    found = tables.read_tiles(spark, _compacted(spark, grid), (3, 5), (1, 3), "1995-06-01", "1997-02-01")
    return found.select("lat_idx", "lon_idx", "obs_date", "precipitation")


@query("grid_daily", "SELECT obs_date, precipitation FROM fx_grid_daily WHERE lat_idx = 7 AND lon_idx = 2")
def stored_series(spark, sf_dir, grid):
    """The whole series of one cell of a table stored by place."""
    return tables.read_tiles(spark, _compacted(spark, grid), (7, 7), (2, 2)).select("obs_date", "precipitation")


@query("manifest", "SELECT CASE WHEN status = 200 THEN 'downloaded' ELSE 'download_failed' END AS event, count(*) * 2 AS n, min(obs_date) AS first_day, max(obs_date) AS last_day FROM fx_manifest GROUP BY 1")
def audit_append(spark, sf_dir, manifest):
    """The events of two runs, appended to the audit table and summed up."""
    path = scratch(spark, "audit")
    events = manifest.select(F.when(F.col("status") == 200, "downloaded").otherwise("download_failed").alias("event"), "obs_date", "path")
    for run in (1, 2):
        tables.append_audit(events.withColumn("run", F.lit(run)), path)
    return tables.audit_summary(spark.read.parquet(path))


@query("grid_daily", "SELECT lat_idx, lon_idx, round(avg(precipitation), 4) AS mean FROM fx_grid_daily GROUP BY ALL")
def csv_export(spark, sf_dir, grid):
    """Cell means written as one CSV file and read again."""
    path = scratch(spark, "csv")
    tables.write_csv(grid.groupBy("lat_idx", "lon_idx").agg(F.round(F.avg("precipitation"), 4).alias("mean")), path)
    return spark.read.schema("lat_idx INT, lon_idx INT, mean DOUBLE").option("header", True).csv(path)


OUTCOMES = "SELECT obs_date, CASE WHEN obs_date < DATE '1996-01-01' THEN 'skipped' WHEN status = 200 THEN 'ok' ELSE 'failed' END AS outcome FROM fx_manifest"


@query("manifest", f""", o AS ({OUTCOMES}) SELECT count(*) FILTER (outcome = 'ok') AS successful, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) AS attempted, round(100e0 * count(*) FILTER (outcome = 'ok') / count(*), 4) AS success_rate,
    max(obs_date) AS latest, count(DISTINCT obs_date) AS total_days, round(100e0 * count(DISTINCT obs_date) / (max(obs_date) - min(obs_date) + 1), 4) AS coverage_pct, max(obs_date) - min(obs_date) + 1 > count(DISTINCT obs_date) AS has_gaps, CAST(max(obs_date) + 1 AS DATE) AS next_expected FROM o""")
def ingest_summary(spark, sf_dir, manifest):
    outcome = F.when(F.col("obs_date") < F.lit("1996-01-01").cast("date"), "skipped").when(F.col("status") == 200, "ok").otherwise("failed")
    found = T.ingest_summary(manifest.select("obs_date", outcome.alias("outcome")), manifest)
    return found.withColumns({c: F.round(c, 4) for c in ("success_rate", "coverage_pct")})


@query("manifest", """, e AS (SELECT CAST(row_number() OVER (ORDER BY obs_date) AS INTEGER) AS seq, 'no file for ' || CAST(obs_date AS VARCHAR) AS message FROM fx_manifest WHERE status <> 200)
    SELECT seq, message FROM e WHERE seq <= 3 UNION ALL SELECT CAST(2147483647 AS INTEGER), '... and ' || CAST(count(*) - 3 AS VARCHAR) || ' more' FROM e HAVING count(*) > 3""")
def error_digest(spark, sf_dir, manifest):
    bad = manifest.where("status <> 200").select("obs_date", F.concat(F.lit("no file for "), F.col("obs_date").cast("string")).alias("message"))
    return T.error_digest(bad, 3, "obs_date")


@query("raster_tile", f""", t AS ({ABS_SQL}), g AS (SELECT * FROM t WHERE band_count = 1 AND crs = 'EPSG:4326'), x AS (SELECT obs_date, pixel_values, unnest(generate_series(0, 63)) AS p FROM g)
    SELECT obs_date, CAST(p // 8 AS INTEGER) AS lat_idx, CAST(p % 8 AS INTEGER) AS lon_idx, round(CAST(pixel_values[p + 1] AS DOUBLE), 6) AS value FROM x""")
def bootstrap_ingest(spark, sf_dir, tiles):
    good, _ = ingest.bootstrap(tiles.withColumn("pixel_values", F.transform("pixel_values", F.abs)), TRANSFORM)
    return good.select("obs_date", "lat_idx", "lon_idx", F.round(F.col("value").cast("double"), 6).alias("value"))


@query("raster_tile", f""", t AS ({ABS_SQL}), g AS (SELECT * FROM t WHERE band_count = 1 AND crs = 'EPSG:4326' AND obs_date BETWEEN DATE '2024-01-01' AND DATE '2024-12-31' AND month(obs_date) % 2 = 0)
    SELECT obs_date, count(*) AS n_cells FROM (SELECT obs_date, unnest(pixel_values) AS v FROM g) GROUP BY 1""")
def gap_fill(spark, sf_dir, tiles):
    """Days of 2024 that a table with the odd months lacks."""
    tiles = tiles.withColumn("pixel_values", F.transform("pixel_values", F.abs))
    existing = tiles.where("month(obs_date) % 2 = 1").select("obs_date")
    return ingest.gap_fill(tiles, existing, "2024-01-01", "2024-12-31", TRANSFORM).groupBy("obs_date").agg(F.count(F.lit(1)).alias("n_cells"))


@query("other_source", "SELECT cell_id, obs_date, source1, source2 FROM fx_other_source")
def incremental_ingest(spark, sf_dir, other):
    """Two drops of files, the second one repeating days of the first, and a run after each: no day is added twice."""
    base = scratch(spark, "incremental")
    rows = other.select("cell_id", "obs_date", "source1", "source2")
    for drop in (rows.where("obs_date < DATE'2024-01-16'"), rows, None):
        if drop is not None:
            drop.write.mode("append").parquet(f"{base}/drops")
        ingest.incremental(spark, f"{base}/drops", rows.schema, f"{base}/table", f"{base}/checkpoint", ["cell_id"])
    return spark.read.parquet(f"{base}/table").select(*rows.columns)


def _event_stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(stream, spark, name, mode):
    """The stream's result table after all available input."""
    path = scratch(spark, name)

    def keep(batch, _):
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/out")

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@query("", "SELECT CAST(ts AS DATE) AS obs_date, event_type, count(value) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_daily(spark, sf_dir):
    found = ingest.daily_windows(_event_stream(spark, sf_dir), "ts", "value", ["event_type"])
    found = _drained(found, spark, "daily", "complete")
    return found.select(F.to_date("window_start").alias("obs_date"), "event_type", "n", F.round("total", 4).alias("total"))


@query("", "SELECT DISTINCT CAST(user_id AS BIGINT) AS user_id, CAST(ts AS DATE) AS obs_date FROM events")
def stream_dedup(spark, sf_dir):
    found = ingest.first_per_day(_event_stream(spark, sf_dir), "ts", ["user_id"]).select(F.col("user_id").cast("long").alias("user_id"), "obs_date")
    return _drained(found, spark, "dedup", "append")
