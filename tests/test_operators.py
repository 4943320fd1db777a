"""Edge cases of the operators on small literal tables."""

import base64
import datetime as dt
import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridwx import catalog
from gridwx.functions import values as V
from gridwx.grid import GridSpec
from gridwx.operators import aggregate, classify, compare, export, merge, points, resample, select, state
from gridwx.sources import raster, tables, vector
from gridwx.streaming import ingest

SPEC = GridSpec(0.225, 30.025, 0.05, 0.05, 10, 10)


def day(text):
    return dt.date.fromisoformat(text)


@settings(max_examples=200, deadline=None)
@given(st.floats(-0.5, 0.5), st.floats(29.5, 31))
def test_nearest_index_is_argmin(lat, lon):
    row, col = SPEC.nearest_index(lat, lon)
    assert abs(0.225 - 0.05 * row - lat) <= min(abs(0.225 - 0.05 * i - lat) for i in range(10)) + 1e-9
    assert abs(30.025 + 0.05 * col - lon) <= min(abs(30.025 + 0.05 * i - lon) for i in range(10)) + 1e-9


def test_nearest_ties_take_the_larger_coordinate(spark):
    spec = GridSpec(1.0, 0.0, 0.5, 0.5, 3, 3)
    rows = spark.createDataFrame([(0.75, 0.25), (9.0, -9.0), (-9.0, 9.0), (None, 0.0)], "lat double, lon double")
    found = points.with_nearest(rows, spec).select("lat_idx", "lon_idx").collect()
    assert [tuple(r) for r in found[:3]] == [(0, 1), (0, 0), (2, 2)]
    assert spec.nearest_index(0.75, 0.25) == (0, 1)


def test_missing_values(spark):
    rows = spark.createDataFrame([(-99.0,), (-9999.0,), (math.nan,), (0.0,), (None,)], "v double")
    assert [r[0] for r in rows.select(V.missing_to_null(F.col("v"))).collect()] == [None, None, None, 0.0, None]


def test_roundings_differ(spark):
    rows = spark.createDataFrame([(0.05,), (0.35,), (0.25,)], "v double")
    r = rows.select(*[V.round1(F.col("v"), m).cast("string") for m in ("np32", "py", "js")]).collect()
    assert [x[0] for x in r] == ["0.0", "0.4", "0.2"]
    assert [x[2] for x in r] == ["0.1", "0.4", "0.3"]
    with pytest.raises(ValueError):
        V.round1(F.col("v"), "other")


def test_negative_zero_keeps_its_sign(spark):
    assert spark.range(1).select(V.one_decimal_text(F.lit(-0.02))).first()[0] == "-0.0"


def test_wet_days(spark):
    rows = spark.createDataFrame([("a", v) for v in (0.04, 0.05, 0.09, 0.1, 0.14)] + [("b", None), ("c", 0.0)], "k string, precipitation double")
    found = {r["k"]: r for r in aggregate.wet_dry_stats(rows, ["k"]).collect()}
    assert (found["a"]["wet_days"], found["a"]["dry_days"]) == (3, 2)
    assert (found["b"]["wet_days"], found["b"]["dry_days"], found["b"]["wet_total"]) == (0, 0, 0.0)
    assert (found["c"]["wet_mean"], found["c"]["dry_days"]) == (0.0, 1)


def test_bins(spark):
    rows = spark.createDataFrame([(day(d), 1.0) for d in ("2024-01-07", "2024-01-08", "2024-03-31", "2024-12-31")], "obs_date date, v double")
    weekly = {r["bin"] for r in resample.resample(rows, "weekly", [], ["v"]).collect()}
    assert {day("2024-01-07"), day("2024-01-14")} <= weekly
    monthly = resample.resample_gapfilled(rows.withColumn("k", F.lit(1)), "monthly", ["k"], ["v"]).collect()
    assert len(monthly) == 12 and sum(r["v"] is None for r in monthly) == 9
    assert [r["bin"] for r in resample.resample(rows, "yearly", [], ["v"]).collect()] == [day("2024-12-31")]


def manifest(spark, pairs):
    return spark.createDataFrame([(day(d), s) for d, s in pairs], "obs_date date, status int")


def test_available_prefix(spark):
    rows = manifest(spark, [("2024-01-01", 200), ("2024-01-02", 200), ("2024-01-03", 404), ("2024-01-04", 200)])
    assert [r[0].day for r in state.available_prefix(rows, "2024-01-01", 10).orderBy("obs_date").collect()] == [1, 2]
    assert state.available_prefix(rows, "2023-12-31", 10).count() == 0
    assert state.available_prefix(rows, "2024-01-01", 1).count() == 1


def test_gaps_and_coverage(spark):
    days = [f"1999-12-{d:02}" for d in (28, 31)] + ["2000-01-03"]
    rows = manifest(spark, [(d, 200) for d in days])
    islands = sorted((r["gap_start"].isoformat(), r["n_days"]) for r in state.gap_islands(rows).collect())
    assert islands == [("1999-12-29", 2), ("2000-01-01", 2)]
    missing = {r[0] for r in state.missing_dates(rows).collect()}
    assert missing | {day(d) for d in days} == {day("1999-12-28") + dt.timedelta(i) for i in range(7)}
    row = state.coverage_stats(rows).first()
    assert (row["expected_days"], row["missing_days"], row["has_gaps"], row["next_day"]) == (7, 4, True, day("2000-01-04"))
    empty = state.coverage_stats(rows.limit(0)).first()
    assert (empty["earliest"], empty["total_days"], empty["coverage_pct"], empty["has_gaps"]) == (None, 0, 0.0, False)


def test_append_twice_is_append_once(spark, tmp_path):
    rows = spark.createDataFrame([(i, day(f"2024-01-{d:02}")) for i in range(3) for d in (1, 2)], "cell int, obs_date date")
    path = str(tmp_path / "t")
    tables.create_table(rows, path)
    more = rows.unionByName(spark.createDataFrame([(9, day("2024-01-05"))], rows.schema))
    assert tables.append(spark, more, path) == 3
    assert tables.append(spark, more, path) == 3
    assert spark.read.parquet(path).count() == 7


def test_compaction_keeps_every_row(spark, tmp_path):
    rows = spark.range(600).selectExpr("CAST(id AS INT) lat_idx", "CAST(id % 300 AS INT) lon_idx", "DATE'2024-01-01' obs_date", "CAST(id AS FLOAT) precipitation")
    tables.create_table(rows, str(tmp_path / "days"))
    tables.compact(spark, str(tmp_path / "days"), str(tmp_path / "tiles"))
    found = spark.read.parquet(str(tmp_path / "tiles"))
    assert found.count() == 600 and {r[0] for r in found.select("tile_lat").distinct().collect()} == {0, 1, 2}


def test_approximate_profile(spark):
    rows = spark.range(1001).selectExpr("CAST(id AS DOUBLE) precipitation")
    exact = [r["value"] for r in aggregate.percentile_profile(rows).orderBy("level").collect()]
    near = [r["value"] for r in aggregate.percentile_profile(rows, accuracy=1000).orderBy("level").collect()]
    assert exact == [0, 100, 250, 500, 750, 900, 950, 990, 1000] and all(abs(a - b) <= 2 for a, b in zip(exact, near))


def test_series_equal_finds_differences(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0), (2, 2.5), (3, None)], "k int, v double")
    assert tuple(aggregate.series_equal(a, b, ["k"], "v").first()) == (3, 0.5, False)
    assert aggregate.series_equal(a, a, ["k"], "v").first()["all_close"]
    assert aggregate.series_equal(a.limit(0), a.limit(0), ["k"], "v").first()["all_close"]


def test_raster_validation(spark):
    schema = "obs_date date, width int, height int, crs string, band_count int, pixel_values array<double>"
    rows = [
        (day("2024-01-01"), 2, 1, "EPSG:4326", 1, [0.0, 2000.0]),
        (day("2024-01-02"), 2, 1, "EPSG:4326", 1, [-9999.0, math.nan]),
        (day("2024-01-03"), 2, 1, "EPSG:4326", 1, [1.0, -1.0]),
        (day("2024-01-04"), 2, 1, "EPSG:4326", 1, [1.0, 2000.1]),
        (day("2024-01-05"), 3, 1, "EPSG:4269", 2, [1.0, 1.0, 1.0]),
    ]
    found = {r["obs_date"].day: r for r in raster.validate_rasters(spark.createDataFrame(rows, schema)).collect()}
    assert found[1]["is_valid"] and found[1]["valid_pct"] == 100.0
    assert found[2]["errors"] == ["No valid data pixels found (all NoData or NaN)"]
    assert found[3]["errors"] == ["Found 1 negative precipitation values"]
    assert found[4]["errors"] == ["Unrealistic max precipitation"]
    assert len(found[5]["errors"]) == 3
    good, bad = ingest.bootstrap(spark.createDataFrame(rows, schema), [0.05, 0.0, 30.0, 0.0, -0.05, 0.25])
    assert (good.count(), bad.count()) == (2, 4)


def test_path_to_date(spark):
    rows = spark.createDataFrame([("a/x.v2.2024.02.29.tif",), ("a/readme.txt",)], "p string")
    assert [r[0] for r in rows.select(raster.path_to_date(F.col("p"))).collect()] == [day("2024-02-29"), None]


def test_tav_amp_needs_a_year(spark):
    start = day("2023-01-01")
    for n, expected in ((364, -99.0), (365, 1.0)):
        rows = spark.createDataFrame([(1, start + dt.timedelta(i), 1.0) for i in range(n)], "k int, obs_date date, T2M double")
        row = merge.tav_amp(rows, ["k"]).first()
        assert (row["tav"], row["amp"]) == (expected, 0.0 if n == 365 else -99.0)
    empty = rows.withColumn("T2M", F.lit(None).cast("double")).withColumn("TMAX", F.lit(1.0)).withColumn("TMIN", F.lit(1.0))
    assert merge.tav_amp(empty, ["k"]).first()["tav"] == -99.0


def one_id(lat, lon, salt=0):
    return points.coordinate_ids(pd.Series([lat]), pd.Series([lon]), pd.Series([salt]))[0]


def test_coordinate_ids():
    assert one_id(1.0, 2.0) != one_id(2.0, 1.0)
    assert one_id(1.0, 2.0) != one_id(1.0, 2.0, 1)
    text = b"lat=+12.34000000;lon=-45.60000000;salt=0"
    assert one_id(12.34, -45.6) == base64.b32encode(hashlib.blake2b(text, digest_size=10).digest()).decode()[:8]


def test_generated_ids_avoid_given_ones(spark):
    taken = one_id(1.0, 2.0)
    rows = spark.createDataFrame([(0, None, 1.0, 2.0), (1, None, 1.0, 2.0), (2, taken, 5.0, 5.0)], "point_seq int, point_id string, lat double, lon double")
    found = {r["point_seq"]: r["point_id"] for r in points.assign_ids(rows).collect()}
    assert found[2] == taken and len(set(found.values())) == 3


def test_ids_of_many_copies_of_a_place(spark):
    """As one after the other would take them: 60 copies of a place, given ids in their way, and none in need of a round each."""
    rows = [(i, None, 1.0, 2.0) for i in range(60)] + [(60 + i, one_id(1.0, 2.0, k), 5.0, 5.0) for i, k in enumerate((0, 7, 8, 40))]
    rows += [(70, None, None, 2.0), (71, "x", None, None)]
    found = {r["point_seq"]: r["point_id"] for r in points.assign_ids(spark.createDataFrame(rows, "point_seq int, point_id string, lat double, lon double"), 3).collect()}
    free = [one_id(1.0, 2.0, k) for k in range(80) if k not in (0, 7, 8, 40)]
    assert [found[i] for i in range(60)] == free[:60]
    assert found[63] == one_id(1.0, 2.0, 40) and found[70] is None and found[71] == "x" and len(found) == 66


def test_validation_report(spark):
    schema = "point_seq int, point_id string, lat double, lon double"
    report = points.validate_points(spark.createDataFrame([(1, "a", 91.0, 0.0), (2, "b", 0.0, 181.0)], schema)).first()
    assert not report["valid"] and report["issues"].count("Point") == 2
    assert points.validate_points(spark.createDataFrame([], schema)).first()["message"] == "No coordinates found in file"
    many = spark.range(5).selectExpr("CAST(id AS INT) point_seq", "CAST(id AS STRING) point_id", "0D lat", "0D lon")
    assert points.validate_points(many, 3).first()["message"] == "Too many points: 5 (max: 3)"


def test_unique_names(spark):
    rows = spark.createDataFrame([(1, "a.WTH"), (2, "a.WTH"), (3, "a_2.WTH"), (4, "a.WTH")], "point_seq int, file_name string")
    found = {r["point_seq"]: r["file_name"] for r in export.unique_names(rows).collect()}
    assert found[1] == "a.WTH" and found[3] == "a_2.WTH" and len(set(found.values())) == 4


def test_geometries(spark):
    shapes = [
        '{"type":"Point","coordinates":[1,2]}', '{"type":"MultiPoint","coordinates":[[1,2],[3,4]]}', '{"type":"Polygon","coordinates":[[[0,0],[1,0],[0,0]],[[9,9]]]}',
        '{"type":"MultiPolygon","coordinates":[[[[0,0],[1,1]]],[[[5,5]]]]}', '{"type":"GeometryCollection","geometries":[]}', '{"type":"Point","coordinates":[]}',
    ]
    rows = [(i, '{"type":"Feature","properties":{"PID":" %s ","name":"x"},"geometry":%s}' % ("" if i == 1 else f"p{i}", s)) for i, s in enumerate(shapes)]
    found = vector.feature_points(spark.createDataFrame(rows, "feature_seq int, feature_json string")).orderBy("feature_seq", "vertex_seq").collect()
    assert [r["feature_seq"] for r in found] == [0, 1, 1, 2, 2, 2, 3, 3, 3]
    assert found[0]["point_id"] == "p0" and found[1]["point_id"] is None


def test_solar_buckets(spark):
    buckets = spark.createDataFrame([("a", day("2000-01-01")), ("b", day("2001-01-01"))], "bucket string, valid_from date")
    rows = spark.createDataFrame([(b, day(d)) for b in "ab" for d in ("2000-12-31", "2001-01-01")], "bucket string, obs_date date")
    assert {(r[0], r[1].year) for r in merge.solar_segments(rows, buckets).collect()} == {("a", 2000), ("b", 2001)}


def test_merge_rejects_unknown_sources(spark):
    with pytest.raises(ValueError):
        merge.merge_sources(spark.range(1), spark.range(1), ["id"], "other")
    with pytest.raises(ValueError):
        merge.met_slice(spark.range(1), ["x"], "2000-01-01", "2000-01-02")
    with pytest.raises(ValueError):
        catalog.region_bounds("nowhere")
    with pytest.raises(ValueError):
        select.single_date(spark.createDataFrame([], "obs_date date"), "2000-01-01")


def test_comparison(spark):
    schema = "k int, obs_date date, value double"
    a = spark.createDataFrame([(1, day("2024-01-01"), 0.25), (1, day("2024-01-02"), None), (1, day("2024-01-03"), math.nan)], schema)
    b = spark.createDataFrame([(1, day("2024-01-01"), 0.2), (1, day("2024-01-02"), 1.0)], schema)
    rows = compare.compare_sources(a, b, ["k"]).collect()
    assert [(r["source1"], r["source2"]) for r in rows] == [(0.3, 0.2)]
    stats = compare.compare_stats(compare.compare_sources(a, b, ["k"]), []).first()
    assert (stats["compared"], stats["different"]) == (1, 1)
    assert compare.compare_stats(compare.compare_sources(a.limit(0), b, ["k"]), []).first()["mean_abs_diff"] == 0.0


def test_rain_text(spark):
    rows = spark.createDataFrame([(1, 0.0), (1, 0.0), (1, 30.0)], "k int, v double")
    row = classify.rain_summary(rows, ["k"], "v", "daily", "mm").first()
    assert row["dominant"] == "no measurable rain" and row["category"] == "intermittently wet"
    assert row["summary"].startswith("Daily Summary\nDuring the selected period, intermittently wet conditions were observed, with an average rainfall of 10 mm.\n\nOut of 3 days:\n1 days recorded rainfall")


def test_streaming_rerun_adds_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(1, day("2024-01-01")), (2, day("2024-01-02"))], "cell int, obs_date date")
    source, table, mark = (str(tmp_path / x) for x in ("in", "table", "mark"))
    rows.write.parquet(source)
    for _ in range(2):
        ingest.incremental(spark, source, rows.schema, table, mark, ["cell"])
    rows.write.mode("append").parquet(source)
    ingest.incremental(spark, source, rows.schema, table, mark, ["cell"])
    assert spark.read.parquet(table).count() == 2


def test_weeks_begin_on_monday(spark):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 7, 12), 1.0, 1), (dt.datetime(2024, 1, 8), 1.0, 1)], "ts timestamp, v double, k int")
    starts = {r[0].date() for r in ingest.daily_windows(rows, "ts", "v", ["k"], every="7 days").collect()}
    assert starts == {day("2024-01-01"), day("2024-01-08")}


def test_a_day_in_two_batches_is_completed(spark, tmp_path):
    schema = "cell int, obs_date date"
    source, table, mark = (str(tmp_path / x) for x in ("in", "table", "mark"))
    for cells in ((1, 2), (2, 3)):
        spark.createDataFrame([(c, day("2024-01-01")) for c in cells], schema).write.mode("append").parquet(source)
        ingest.incremental(spark, source, spark.createDataFrame([], schema).schema, table, mark, ["cell"])
    assert sorted(r["cell"] for r in spark.read.parquet(table).collect()) == [1, 2, 3]


def test_rasters_in_a_folder(spark, tmp_path):
    rng = np.random.default_rng(0)
    pixels = {d: rng.random((7, 11)).astype("<f4") for d in ("2024.01.01", "2024.01.02", "2024.01.04")}
    for d, values in pixels.items():
        (tmp_path / f"rain.{d}.tif").write_bytes(values.tobytes())
    (tmp_path / "rain.2024.01.03.tif").write_bytes(b"cut off")
    (tmp_path / "notes.txt").write_text("x")
    tiles = raster.read_rasters(spark, str(tmp_path), raster.float32_decoder(11, 7), side=4)
    assert tiles.where("width IS NOT NULL").count() == 3 * 2 * 3
    cells = {(str(r["obs_date"]), r["lat_idx"], r["lon_idx"]): r["value"] for r in raster.explode_cells(tiles).collect()}
    assert cells == {(d.replace(".", "-"), r, c): v[r, c] for d, v in pixels.items() for r in range(7) for c in range(11)}

    decode, table = raster.float32_decoder(11, 7), str(tmp_path / "table")
    files = raster.raster_files(spark, str(tmp_path))
    first = ingest.bootstrap_run(spark, files.where("path LIKE '%2024.01.01%'"), decode, table)
    assert [tuple(r)[:2] for r in first.collect()] == [(day("2024-01-01"), "ok")]
    plan = ingest.incremental_run(spark, files, decode, table, dry_run=True)
    assert [r["outcome"] for r in plan.orderBy("obs_date").collect()] == ["planned"] * 3 + ["missing"]
    assert spark.read.parquet(table).count() == 77
    done = ingest.incremental_run(spark, files, decode, table, max_days=2).orderBy("obs_date").collect()
    assert [(r["outcome"], len(r["errors"])) for r in done] == [("ok", 0), ("failed", 1)]
    done = ingest.incremental_run(spark, files, decode, table, force_date="2024-01-01").orderBy("obs_date").collect()
    assert [r["outcome"] for r in done] == ["skipped", "skipped", "failed", "ok", "missing"]
    before = spark.read.parquet(table).count()
    done = ingest.incremental_run(spark, files, decode, table).collect()
    assert [r["outcome"] for r in done] == ["missing"] and spark.read.parquet(table).count() == before == 3 * 77
    meta = {r["key"]: r["value"] for r in tables.finalise(spark, table, spark.createDataFrame([('{"title": "Rain", "x": 1}',)], "value string")).collect()}
    assert meta["title"] == "Rain" and meta["source"] == "Daily rasters" and "x" not in meta and meta["time_coverage_end"] == "2024-01-04"


def test_transforms_can_be_compared(spark):
    schema = raster.TILE + ", obs_date date"
    rows = [(f"a{i}", 1, 1, "E", [0.05, 0.0, 30.0 + i, 0.0, -0.05, 0.0], None, 1, 0, 0, 1, [1.0], day(f"2024-01-0{i + 1}")) for i in range(2)]
    tiles = spark.createDataFrame(rows, schema)
    assert [r["is_valid"] for r in raster.validate_rasters(tiles).collect()] == [True, True]
    assert sorted(tuple(r["errors"]) for r in raster.validate_rasters(tiles, same_transform=True).collect()) == [(), ("Transform mismatch",)]


def test_deviation_of_large_values(spark):
    values = [1e8 + x for x in (0.0, 1.0, 2.0, 3.0)]
    grid = spark.createDataFrame([(0.0, float(i % 2), v) for i, v in enumerate(values)], "latitude double, longitude double, precipitation double")
    regions = spark.createDataFrame([("r", -1.0, 2.0, -1.0, 1.0)], "region string, lon_min double, lon_max double, lat_min double, lat_max double")
    assert aggregate.region_stats(grid, regions).first()["std"] == pytest.approx(np.std(values), rel=1e-9)


def test_variable_texts(spark):
    rows = [("SRAD", 7.2), ("SRAD", 14.4), ("TDEW", 10.0), ("RAIN", 0.0), ("X1", 1.25), ("T2M", None), ("TMAX", float("nan"))]
    found = {r["code"]: r for r in classify.variable_texts(spark.createDataFrame(rows, "code string, value double"), catalog.variables(spark), "weekly").collect()}
    assert found["SRAD"]["summary"].endswith("mean was 3 (range 2 to 4), which is classified as high solar irradiation for this aggregation.")
    assert "Converted to Fahrenheit, mean dew point was 50 F, indicating dry and comfortable conditions" in found["TDEW"]["summary"]
    assert found["X1"]["summary"] == "At weekly aggregation for X1, the mean was 1.3  (range 1.3 to 1.3 ; 1 intervals). No specialized meteorological threshold set is currently mapped for X1."
    assert found["T2M"]["summary"] == found["TMAX"]["summary"] == classify.NO_DATA and found["T2M"]["sources"] == []
    assert found["RAIN"]["summary"].startswith("Weekly Summary") and len(found["RAIN"]["sources"]) == 2


def test_sources_without_repeats(spark):
    rows = [([("a", "u"), ("b", "v"), ("c", "u")],), ([],)]
    found = spark.createDataFrame(rows, "s " + classify.SOURCE_LIST).select(classify.unique_sources(F.col("s"))).collect()
    assert [[x["label"] for x in r[0]] for r in found] == [["a", "b"], []]


def test_series_by_source(spark):
    chirps = spark.createDataFrame([(1, day("2024-01-01"), 5.0)], "k int, obs_date date, RAIN double")
    nasa = spark.createDataFrame([(1, day("2024-01-01"), 6.0, 20.0)], "k int, obs_date date, RAIN1 double, T2M double")
    both = {"chirps": chirps, "nasa_s3": nasa}
    assert merge.series_by_source(both, "chirps", "RAIN").first()["RAIN"] == 5.0
    assert merge.series_by_source(both, "nasa_s3", "RAIN").first()["RAIN"] == 6.0
    assert merge.series_by_source(both, "nasa_s3", "T2M").columns == ["k", "obs_date", "T2M"]
    for source, code in (("chirps", "T2M"), ("other", "RAIN")):
        with pytest.raises(ValueError):
            merge.series_by_source(both, source, code)
