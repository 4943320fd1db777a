"""Tables with a day log: atomic loads, appends that read no old row, and ingestion that refuses what does not belong."""

import datetime
import json
import shutil
import warnings
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwx.sources import daylog, raster, tables
from gridwx.streaming import ingest


def day(n: int) -> datetime.date:
    return datetime.date(2024, 1, n)


def cells(spark, *days, n=3, value=1.0):
    rows = [(i, day(d), value) for d in days for i in range(n)]
    return spark.createDataFrame(rows, "cell int, obs_date date, precipitation double")


def logged(spark, path):
    return {r["obs_date"].day: r["cells"] for r in daylog.days(spark, path).collect()}


def first_load(path):
    return sorted(Path(path).glob("load=*"))[0]


def test_append_reads_no_old_row(spark, tmp_path):
    path = str(tmp_path / "t")
    daylog.create(spark, path, cells(spark, 1, 2))
    # the old days' files are gone: an append that looked into them would fail
    kept = tmp_path / "kept"
    shutil.copytree(first_load(path), kept)
    shutil.rmtree(first_load(path))
    added = daylog.append(spark, path, cells(spark, 2, 3))
    assert [(r["obs_date"], r["cells"]) for r in added.collect()] == [(day(3), 3)]
    assert daylog.append(spark, path, cells(spark, 1, 2, 3)).count() == 0
    assert logged(spark, path) == {1: 3, 2: 3, 3: 3}
    load = next(r["load"] for r in daylog.days(spark, path).collect() if r["obs_date"] == day(1))
    shutil.copytree(kept, Path(path) / f"load={load}")
    found = daylog.read(spark, path)
    assert found.count() == 9 and found.columns == ["cell", "obs_date", "precipitation"]
    assert daylog.read(spark, path, "2024-01-03").count() == 3 and daylog.read(spark, path, last="2023-12-31").count() == 0


def test_reads_touch_the_months_folders_only(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = cells(spark, *range(1, 20))
    daylog.create(spark, path, rows.unionByName(rows.withColumn("obs_date", F.add_months("obs_date", 1))))
    found = daylog.read(spark, path, "2024-01-05", "2024-01-06")
    files = [f for f in found.inputFiles() if "load=" in f]
    assert files and all("month=2024-01" in f for f in files)
    assert found.count() == 6 and "GreaterThanOrEqual(obs_date,2024-01-05)" in found._jdf.queryExecution().executedPlan().toString()


def test_killed_load_leaves_no_half_day(spark, tmp_path):
    path = str(tmp_path / "t")
    daylog.create(spark, path, cells(spark, 1))
    broken = cells(spark, 2, 3).repartition(3).withColumn("precipitation", F.when(F.col("cell") == 2, F.raise_error(F.lit("lost")).cast("double")).otherwise(1.0))
    with pytest.raises(Exception, match="lost"):
        daylog.append(spark, path, broken)
    assert logged(spark, path) == {1: 3} and daylog.read(spark, path).count() == 3
    # data without an entry, and an entry that was not completed
    cells(spark, 4).withColumn("month", F.lit("2024-01")).write.partitionBy("month").parquet(f"{path}/load=dead")
    (Path(path) / "_log" / f"{9:012d}").mkdir()
    assert logged(spark, path) == {1: 3} and daylog.read(spark, path).count() == 3
    daylog.append(spark, path, cells(spark, 2))
    assert logged(spark, path) == {1: 3, 2: 3}
    gone = daylog.vacuum(spark, path)
    assert "load=dead" in gone and f"_log/{9:012d}" in gone and daylog.read(spark, path).count() == 6


def test_replacing_a_day(spark, tmp_path):
    path = str(tmp_path / "t")
    daylog.create(spark, path, cells(spark, 1, 2))
    daylog.append(spark, path, cells(spark, 2, n=5, value=7.0), replace=True)
    assert logged(spark, path) == {1: 3, 2: 5}
    assert sorted(r[0] for r in daylog.read(spark, path).select("precipitation").collect()) == [1.0] * 3 + [7.0] * 5


def test_a_second_load_of_the_same_entry_fails(spark, tmp_path):
    path = str(tmp_path / "t")
    daylog.create(spark, path, cells(spark, 1))
    with pytest.raises(daylog.TableError):
        daylog.create(spark, path, cells(spark, 2))
    state, number = daylog._state(spark, path)
    daylog.put(spark, path, {"a": "1"})
    with pytest.raises(daylog.TableError, match="faster"):
        daylog._publish(spark, path, state, number)
    with pytest.raises(daylog.TableError):
        daylog.days(spark, str(tmp_path / "none"))


def test_empty_loads_and_null_days(spark, tmp_path):
    path = str(tmp_path / "t")
    daylog.create(spark, path, cells(spark).limit(0))
    assert logged(spark, path) == {} and daylog.read(spark, path).count() == 0
    rows = cells(spark, 1).unionByName(spark.createDataFrame([(1, None, 2.0)], "cell int, obs_date date, precipitation double"))
    daylog.append(spark, path, rows)
    assert logged(spark, path) == {1: 3} and daylog.read(spark, path).count() == 3


SIDE = 4


def content(values, bands=1, crs=4326, step=0.05, left=30.0, width=SIDE):
    return json.dumps({"bands": bands, "crs": crs, "step": step, "left": left, "width": width, "values": np.asarray(values, float).ravel().tolist()}).encode()


def decode(raw):
    head = json.loads(raw)
    if head["bands"] < 0:
        raise OSError("truncated block")
    if head["bands"] == 0:
        raise KeyError("band")
    pixels = np.array(head["values"], "<f4").reshape(-1, head["width"])
    return raster.Raster(pixels, f"EPSG:{head['crs']}", (head["step"], 0.0, head["left"], 0.0, -head["step"], 1.0), None, head["bands"])


def files(spark, *rows):
    return spark.createDataFrame([(f"in/{folder}/rain.2024.01.{d:02}.tif", bytearray(c)) for d, folder, c in rows], "path string, content binary")


GOOD = content(np.ones((SIDE, SIDE)))


def result(df):
    return sorted(((r["obs_date"] and r["obs_date"].day, r["path"] and r["path"].split("/")[1], r["outcome"], tuple(r["errors"])) for r in df.collect()), key=repr)


def test_bootstrap_refuses_what_does_not_belong(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = files(
        spark,
        (1, "a", content(np.ones((SIDE, SIDE)), crs=4269)),  # odd first raster: no reference for the others
        (2, "a", GOOD), (2, "b", GOOD), (2, "c", GOOD),
        (3, "a", content(-np.ones((SIDE, SIDE)))), (3, "b", GOOD),
        (4, "a", content(np.ones((6, 6)), width=6)),
        (5, "a", content(np.ones((SIDE, SIDE)), step=0.5)),
        (6, "a", content(np.ones((SIDE, SIDE)), left=31.0)),
        (7, "a", content(np.ones((SIDE, SIDE)), bands=-1)), (8, "a", content(np.ones((SIDE, SIDE)), bands=0)), (9, "a", b"no json"),
        (10, "a", GOOD),
    ).unionByName(spark.createDataFrame([("in/x/undated.tif", bytearray(GOOD))], "path string, content binary"))
    found = result(ingest.bootstrap_run(spark, rows, decode, path))
    by_file = {(d, f): (o, e) for d, f, o, e in found}
    assert by_file[1, "a"] == ("failed", ("Unexpected CRS: EPSG:4269, expected EPSG:4326", "CRS mismatch"))
    assert by_file[2, "a"] == ("ok", ()) and by_file[2, "b"] == by_file[2, "c"] == ("failed", ("Another file of this day",))
    assert by_file[3, "a"][0] == "failed" and by_file[3, "b"] == ("ok", ())
    assert by_file[4, "a"] == ("failed", ("Width mismatch", "Height mismatch"))
    assert by_file[5, "a"] == ("failed", ("Unexpected X resolution: 0.5, expected 0.05", "Unexpected Y resolution: 0.5, expected 0.05", "Transform mismatch"))
    assert by_file[6, "a"] == ("failed", ("Transform mismatch",))
    assert by_file[7, "a"] == ("failed", ("File cannot be decoded: OSError: truncated block",))
    assert by_file[8, "a"][1][0].startswith("File cannot be decoded: KeyError") and by_file[9, "a"][1][0].startswith("File cannot be decoded: JSONDecodeError")
    assert by_file[None, "x"] == ("failed", ("No day in the file's name",))
    assert logged(spark, path) == {2: 16, 3: 16, 10: 16}
    assert daylog.read(spark, path).groupBy("obs_date", "lat_idx", "lon_idx").count().where("count > 1").count() == 0


def test_incremental_holds_rasters_against_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    ingest.bootstrap_run(spark, files(spark, (1, "a", GOOD), (2, "a", GOOD)), decode, path)
    shutil.rmtree(first_load(path))  # nothing but the log is read
    rows = files(
        spark, (3, "a", GOOD), (3, "b", GOOD), (4, "a", content(np.ones((6, 6)), width=6)), (5, "a", content(np.ones((SIDE, SIDE)), left=9.0)),
        (6, "a", content(np.ones((SIDE, SIDE)), bands=-1)), (7, "a", GOOD),
    )
    done = result(ingest.incremental_run(spark, rows, decode, path))
    assert [(d, f, o) for d, f, o, _ in done] == [(3, "a", "ok"), (3, "b", "failed"), (4, "a", "failed"), (5, "a", "failed"), (6, "a", "failed"), (7, "a", "ok"), (8, None, "missing")]
    assert logged(spark, path) == {1: 16, 2: 16, 3: 16, 7: 16}
    again = result(ingest.incremental_run(spark, rows, decode, path, force_date="2024-01-03"))
    assert [(d, o) for d, _, o, _ in again] == [(3, "skipped"), (4, "failed"), (5, "failed"), (6, "failed"), (7, "skipped"), (8, "missing")]
    assert daylog.properties(spark, path)["time_coverage_end"] == "2024-01-07"


def test_stored_state(spark, tmp_path):
    path = str(tmp_path / "t")
    daylog.create(spark, path, cells(spark, 1).selectExpr("cell lat_idx", "cell lon_idx", "CAST(cell AS DOUBLE) latitude", "CAST(cell AS DOUBLE) longitude", "obs_date", "precipitation"))
    with pytest.warns(ingest.UnfinishedTable):
        done = ingest.incremental_run(spark, files(spark, (2, "a", GOOD)), decode, path, dry_run=True)
    assert result(done) == [(2, None, "planned", ()), (3, None, "missing", ())]
    meta = spark.createDataFrame([('{"title": "Rain"}',)], "value string")
    returned = {r["key"]: r["value"] for r in tables.finalise(spark, path, meta).collect()}
    stored = {r["key"]: r["value"] for r in tables.stored_metadata(spark, path).collect()}
    assert returned.items() <= stored.items()
    assert (stored["title"], stored["bootstrap_complete"], stored["time_coverage_end"], stored["geospatial_lat_max"]) == ("Rain", "true", "2024-01-01", "2.0000")
    with warnings.catch_warnings():
        warnings.simplefilter("error", ingest.UnfinishedTable)
        ingest.incremental_run(spark, files(spark, (2, "a", GOOD)), decode, path, dry_run=True)
