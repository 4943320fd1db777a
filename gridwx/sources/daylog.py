"""Tables of days with a log.

A load writes its days to a folder of its own, `load=<id>/month=<month>/`, and publishes them by a log entry, `_log/<number>`,
that is written last. An entry is the whole state of the table: its days with the load that holds each and their rows, and
its properties. A table has as many days as the calendar, so an entry is small; what is in the table, what a load may add
and where a read must look are known from the last entry, without a scan of the table. A load that dies before its entry is
complete has published nothing: readers go by the last complete entry, and `vacuum` removes what no entry names.
"""

from __future__ import annotations

import datetime
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

ENTRY = "obs_date date, load string, cells long, key string, value string"
LOG = "_log"
MONTH, LOAD = "month", "load"
#: Entries that stay readable after a vacuum, for readers that began on an earlier one.
KEPT_ENTRIES = 5


class TableError(ValueError):
    """A table that is missing, exists already, or was changed by another load meanwhile."""


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _names(spark: SparkSession, path: str) -> list[str]:
    files, place = _folder(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(place)) if files.exists(place) else []


def _entries(spark: SparkSession, path: str) -> tuple[list[int], int]:
    """The complete entries' numbers in order, and the highest number in use, or 0."""
    files, _ = _folder(spark, path)
    names = [n for n in _names(spark, f"{path}/{LOG}") if n.isdigit()]
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    whole = [int(n) for n in names if files.exists(jvm_path(f"{path}/{LOG}/{n}/_SUCCESS"))]
    return whole, max(map(int, names), default=0)


def exists(spark: SparkSession, path: str) -> bool:
    return bool(_entries(spark, path)[0])


def _state(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The rows of the last complete entry, and the number for the next one."""
    whole, highest = _entries(spark, path)
    if not whole:
        raise TableError(f"no table at {path}")
    return spark.read.schema(ENTRY).parquet(f"{path}/{LOG}/{whole[-1]:012d}"), highest + 1


def _publish(spark: SparkSession, path: str, rows: DataFrame, number: int) -> None:
    try:
        rows.coalesce(1).write.mode("errorifexists").parquet(f"{path}/{LOG}/{number:012d}")
    except Exception as error:
        if "PATH_ALREADY_EXISTS" in str(error):
            raise TableError(f"another load of {path} was faster; run this one again") from error
        raise


def _property_rows(spark: SparkSession, properties: dict[str, str]) -> DataFrame:
    rows = [(None, None, None, k, str(v)) for k, v in properties.items()]
    return spark.createDataFrame(rows, ENTRY)


def days(spark: SparkSession, path: str) -> DataFrame:
    """obs_date, cells (rows), load: the table's days, from the log alone."""
    rows = _state(spark, path)[0].where("obs_date IS NOT NULL")
    # entries written at one moment by two loads may both name a day: one of them holds it
    return rows.groupBy("obs_date").agg(F.max(F.struct("load", "cells")).alias("d")).select("obs_date", "d.cells", "d.load")


def properties(spark: SparkSession, path: str) -> dict[str, str]:
    """What is stored with the table, from the log alone."""
    return {r["key"]: r["value"] for r in _state(spark, path)[0].where("key IS NOT NULL").collect()}


def put(spark: SparkSession, path: str, changed: dict[str, str]) -> None:
    """Set properties; the others stay."""
    state, number = _state(spark, path)
    kept = state.where(F.col("key").isNull() | ~F.col("key").isin(*changed))
    _publish(spark, path, kept.unionByName(_property_rows(spark, changed)), number)


def create(spark: SparkSession, path: str, cells: DataFrame, stored: dict[str, str] | None = None) -> DataFrame:
    """Make a table of cells (with obs_date); returns the days added. An existing table is an error."""
    if exists(spark, path):
        raise TableError(f"a table exists at {path}")
    load, added = _write(spark, path, cells)
    stored = {"schema": cells.schema.json(), **(stored or {})}
    number = _entries(spark, path)[1] + 1
    _publish(spark, path, _day_rows(added, load).unionByName(_property_rows(spark, stored)), number)
    return added


def append(spark: SparkSession, path: str, cells: DataFrame, replace: bool = False, changed: dict[str, str] | None = None) -> DataFrame:
    """Add the days of cells that the table lacks, or with replace all of its days, in place of the table's own.

    Returns obs_date and cells (rows) of the days added. No row of the table is read: its days are known from the log and
    a load's rows are counted from its own files. A repeated load adds nothing; one that dies leaves the table as it was.
    Changed properties are published with the days, in one entry.
    """
    state, number = _state(spark, path)
    if not replace:
        cells = cells.join(F.broadcast(days(spark, path).select("obs_date")), "obs_date", "left_anti").select(*cells.columns)
    load, added = _write(spark, path, cells)
    if added.isEmpty() and not changed:
        return added
    kept = state.join(F.broadcast(added.select("obs_date")), "obs_date", "left_anti").select(*state.columns)
    if changed:
        kept = kept.where(F.col("key").isNull() | ~F.col("key").isin(*changed)).unionByName(_property_rows(spark, changed))
    _publish(spark, path, kept.unionByName(_day_rows(added, load)), number)
    return added


def _write(spark: SparkSession, path: str, cells: DataFrame) -> tuple[str, DataFrame]:
    """A load's name, in the order of time, and obs_date, cells of its days."""
    load = f"{datetime.datetime.now(datetime.timezone.utc):%Y%m%d%H%M%S%f}-{uuid.uuid4().hex[:12]}"
    rows = cells.where("obs_date IS NOT NULL").withColumn(MONTH, F.date_format("obs_date", "yyyy-MM"))
    rows.sortWithinPartitions(MONTH, "obs_date").write.partitionBy(MONTH).parquet(f"{path}/load={load}")
    written = spark.read.schema(cells.schema).parquet(f"{path}/load={load}")
    return load, written.groupBy("obs_date").agg(F.count(F.lit(1)).alias("cells"))


def _day_rows(added: DataFrame, load: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return added.select("obs_date", F.lit(load).alias("load"), "cells", none.alias("key"), none.alias("value"))


def read(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """The table's rows from first to last (both inclusive; none: all). Only the folders of their months are listed and
    read, and in these the row groups that may hold the days."""
    wanted = days(spark, path)
    if first is not None:
        wanted = wanted.where(F.col("obs_date") >= F.lit(first).cast("date"))
    if last is not None:
        wanted = wanted.where(F.col("obs_date") <= F.lit(last).cast("date"))
    return _rows(spark, path, wanted)


def read_days(spark: SparkSession, path: str, wanted: list[str]) -> DataFrame:
    """The table's rows of these days (texts); days that it lacks give none."""
    chosen = spark.createDataFrame([(d,) for d in wanted], "d string").select(F.col("d").cast("date").alias("obs_date"))
    return _rows(spark, path, days(spark, path).join(F.broadcast(chosen), "obs_date", "left_semi"))


def _rows(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Rows of these days (obs_date, load), each from the load that holds it."""
    schema = StructType.fromJson(json.loads(properties(spark, path)["schema"]))
    month = F.date_format("obs_date", "yyyy-MM").alias(MONTH)
    found = wanted.groupBy(LOAD, month).agg(F.min("obs_date").alias("a"), F.max("obs_date").alias("b")).collect()
    if not found:
        return spark.createDataFrame([], schema)
    whole = StructType([*schema.fields, StructField(LOAD, StringType()), StructField(MONTH, StringType())])
    rows = spark.read.schema(whole).option("basePath", path).parquet(*[f"{path}/{LOAD}={r[LOAD]}/{MONTH}={r[MONTH]}" for r in found])
    rows = rows.where(F.col("obs_date").between(F.lit(min(r["a"] for r in found)), F.lit(max(r["b"] for r in found))))
    # a load may hold days that another one has replaced since
    return rows.join(F.broadcast(wanted.select(LOAD, "obs_date")), [LOAD, "obs_date"], "left_semi").select(*schema.names)


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Delete loads that none of the last entries names, and older entries; returns what went. No load may be under way."""
    whole, _ = _entries(spark, path)
    kept = whole[-KEPT_ENTRIES:]
    rows = spark.read.schema(ENTRY).parquet(*[f"{path}/{LOG}/{n:012d}" for n in kept])
    named = {r[0] for r in rows.where("load IS NOT NULL").select("load").distinct().collect()}
    gone = [n for n in _names(spark, path) if n.startswith("load=") and n[5:] not in named]
    gone += [f"{LOG}/{n}" for n in _names(spark, f"{path}/{LOG}") if n.isdigit() and int(n) not in kept]
    for name in gone:
        files, place = _folder(spark, f"{path}/{name}")
        files.delete(place, True)
    return gone
