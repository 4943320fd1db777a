"""Ingestion of daily rasters: batch bootstrap, incremental file stream, quarantine; streaming resample and de-duplication."""

from __future__ import annotations

import datetime
import json
import warnings
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwx.operators.state import available_prefix
from gridwx.sources import daylog, raster, tables
from gridwx.workspace import staged


OUTCOME = ["obs_date", "outcome", "errors", "path"]
_NO_ERRORS = "CAST(array() AS ARRAY<STRING>) errors"


class UnfinishedTable(UserWarning):
    """The table was never finalised: its bootstrap may have been cut short."""


def outcomes(wanted: DataFrame, existing: DataFrame, checked: DataFrame) -> DataFrame:
    """OUTCOME rows of each wanted day: skipped (the table has it), missing (no raster), or failed or ok for each of its files."""
    have = existing.select("obs_date").distinct().withColumn("exists", F.lit(True))
    rows = wanted.join(have, "obs_date", "left").join(checked.select("obs_date", "path", "is_valid", "errors"), "obs_date", "left")
    outcome = F.when(F.col("exists"), "skipped").when(F.col("is_valid").isNull(), "missing").when(~F.col("is_valid"), "failed").otherwise("ok")
    return rows.select("obs_date", outcome.alias("outcome"), F.coalesce("errors", F.array().cast("array<string>")).alias("errors"), "path")


def bootstrap(tiles: DataFrame, transform: list[float] | None = None, nodata: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Cells of the valid rasters, and the quarantined rasters with their errors. A bad raster does not stop the others."""
    checked = raster.validate_rasters(tiles, nodata)
    by = ["path", "obs_date"] if "path" in tiles.columns else ["obs_date"]
    good = tiles.join(checked.where("is_valid").select(*by), by, "left_semi")
    cells = raster.explode_cells(good, transform)
    value = raster.valid_pixel(F.col("value"), F.lit(nodata).cast("double"))
    return cells.withColumn("value", value), checked.where("NOT is_valid")


def bootstrap_run(
    spark: SparkSession, files: DataFrame, decode: Callable[[bytes], raster.Raster], table: str, nodata: float | None = None,
    crs: str | None = raster.CRS, resolution: float | None = raster.RESOLUTION,
) -> DataFrame:
    """Make a table of the rasters (path, content) that pass validation, a partition per day, finalise it, and return the
    outcome of each file: obs_date, outcome (ok or failed), errors, path. An existing table is an error; a bad raster does
    not stop the others. The size, place and reference system of the first valid raster are stored as the table's own."""
    tiles = staged(raster.decode_rasters(files, decode), "tiles")
    facts = staged(raster.raster_facts(tiles, nodata), "facts")
    checked = staged(raster.check_rasters(facts, None, crs, resolution, same_transform=True), "checked")
    daylog.create(spark, table, _cells(tiles, checked, nodata), _own_grid(checked))
    tables.finalise(spark, table, spark.createDataFrame([], "value string"))
    return checked.select("obs_date", F.when(F.col("is_valid"), "ok").otherwise("failed").alias("outcome"), "errors", "path")


def incremental_run(
    spark: SparkSession, files: DataFrame, decode: Callable[[bytes], raster.Raster], table: str, force_date: str | None = None, max_days: int = 30, dry_run: bool = False, nodata: float | None = None,
    crs: str | None = raster.CRS, resolution: float | None = raster.RESOLUTION,
) -> DataFrame:
    """Append the days after the table's latest (or from force_date on) as far as files follow each other, max_days at most.

    Returns obs_date, outcome, errors, path for each file of such a day: ok or failed; skipped for a day that the table has,
    and missing for the day at which the files end before max_days. A dry run writes nothing and says planned in place of
    ok. A repeated run adds nothing. A raster must have the size, place and reference system that the table's log tells;
    nothing but the log is read of the table. One that was never finalised is warned of.
    """
    stored = daylog.properties(spark, table)
    if stored.get("bootstrap_complete") != "true":
        warnings.warn(f"{table} was not finalised", UnfinishedTable, stacklevel=2)
    existing = staged(daylog.days(spark, table).select("obs_date"), "days")
    latest = existing.agg(F.date_add(F.max("obs_date"), 1)).first()[0]
    if force_date is None and latest is None:
        raise daylog.TableError(f"{table} has no day to go on from; give force_date")
    start = force_date or str(latest)
    have = files.select(raster.path_to_date(F.col("path")).alias("obs_date")).where("obs_date IS NOT NULL").distinct().withColumn("status", F.lit(200))
    wanted = staged(available_prefix(have, start, max_days), "wanted")
    todo = wanted.join(existing, "obs_date", "left_anti")
    if dry_run:
        found = wanted.join(existing.withColumn("has", F.lit(True)), "obs_date", "left")
        done = found.selectExpr("obs_date", "IF(has, 'skipped', 'planned') outcome", _NO_ERRORS, "CAST(NULL AS STRING) path")
    else:
        mine = files.withColumn("obs_date", raster.path_to_date(F.col("path"))).join(F.broadcast(todo), "obs_date", "left_semi")
        tiles = staged(raster.decode_rasters(mine, decode), "tiles")
        facts = staged(raster.raster_facts(tiles, nodata), "facts")
        own = json.loads(stored["grid"]) if "grid" in stored else None
        checked = staged(raster.check_rasters(facts, own, crs, resolution, same_transform=True), "checked")
        added = daylog.append(spark, table, _cells(tiles, checked, nodata))
        span = added.agg(F.max("obs_date")).first()[0]
        changed = _own_grid(checked) if own is None else {}
        if span is not None:
            changed |= {"time_coverage_end": str(max(span, latest.fromordinal(latest.toordinal() - 1)) if latest else span)}
        if changed:
            daylog.put(spark, table, changed | {"date_modified": datetime.datetime.now(datetime.timezone.utc).isoformat(timespec="seconds")})
        done = outcomes(wanted, existing, checked)
    n = wanted.count()
    if n < max_days:
        end = spark.range(1).select(F.date_add(F.lit(start).cast("date"), n).alias("obs_date"))
        done = done.unionByName(end.selectExpr("obs_date", "'missing' outcome", _NO_ERRORS, "CAST(NULL AS STRING) path"))
    return done


def _own_grid(checked: DataFrame) -> dict[str, str]:
    """The table property that tells size, place and reference system: those of the first valid raster, if any."""
    first = checked.where("is_valid").orderBy("obs_date", "path").select("width", "height", "crs", "transform").first()
    return {"grid": json.dumps(first.asDict())} if first else {}


def _cells(tiles: DataFrame, checked: DataFrame, nodata: float | None) -> DataFrame:
    good = tiles.join(F.broadcast(checked.where("is_valid").select("path")), "path", "left_semi")
    value = raster.valid_pixel(F.col("value"), F.lit(nodata).cast("double"))
    return raster.explode_cells(good).withColumn("precipitation", value).drop("value")


def gap_fill(tiles: DataFrame, existing: DataFrame, first: str, last: str, transform: list[float] | None = None) -> DataFrame:
    """Cells of rasters for days of the range that the table lacks, whatever the order in which they arrive."""
    from gridwx.operators.state import missing_dates

    missing = missing_dates(existing, first, last)
    return bootstrap(tiles.join(missing, "obs_date", "left_semi"), transform)[0]


def incremental(spark: SparkSession, source: str, schema, table: str, checkpoint: str, keys: list[str]) -> None:
    """Every file that has arrived since the last run, once: rows whose keys the table lacks on their day are appended.

    A day that comes in several batches is completed, repeated rows are skipped, and a batch that is run again after a
    failure adds nothing twice. Only the days of the batch are read from the table.
    """
    by = [*keys, "obs_date"]

    def add(batch: DataFrame, _: int) -> None:
        new = staged(batch.dropDuplicates(by), "batch")
        try:
            existing = batch.sparkSession.read.parquet(table)
        except AnalysisException as error:  # the first run has no table yet
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        else:
            days = F.broadcast(new.select("obs_date").distinct())
            new = new.join(existing.join(days, "obs_date", "left_semi").select(*by), by, "left_anti")
        new.write.partitionBy("obs_date").mode("append").parquet(table)

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def daily_windows(events: DataFrame, time: str, value: str, keys: list[str], lateness: str = "31 days", every: str = "1 day") -> DataFrame:
    """Tumbling days, or weeks that begin on Monday, of a stream with late rows (a batch table works alike)."""
    start = "4 days" if every == "7 days" else None
    window = F.window(time, every, every, start) if start else F.window(time, every)
    if events.isStreaming:
        events = events.withWatermark(time, lateness)
    found = events.groupBy(window.alias("w"), *keys).agg(F.count(value).alias("n"), F.sum(value).alias("total"))
    return found.select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def first_per_day(events: DataFrame, time: str, keys: list[str], lateness: str = "31 days") -> DataFrame:
    """One record per key and day."""
    rows = events.withColumn("obs_date", F.to_date(time))
    if events.isStreaming:
        return rows.withWatermark(time, lateness).dropDuplicatesWithinWatermark([*keys, "obs_date"])
    return rows.dropDuplicates([*keys, "obs_date"])
