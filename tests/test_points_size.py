"""Queries over points whose copies and numbers are beyond what a small table holds."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from gridwx import plans
from gridwx.operators import export
from gridwx.operators import points as P
from gridwx.plans.registry import FINE

DAYS = 100


def customers(spark, folder, n, step):
    rows = spark.range(n).selectExpr(f"id * {step} + 1 AS c_custkey", f"concat('Customer#', id * {step} + 1) AS c_name")
    rows.coalesce(1).write.parquet(f"{folder}/customer.parquet")
    return str(folder)


def test_id_facts_of_a_place_with_many_copies(spark, tmp_path):
    """40 points of one place, none of which has an id of its own."""
    found = plans.queries()["point_id_facts"](spark, customers(spark, tmp_path, 40, 600)).first()
    assert found.asDict() == {"points": 40, "distinct_ids": 40, "given_kept": 0, "of_eight": 40}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """2000 sites, 3000 customers, and 100 days of a grid of 100 cells."""
    path = tmp_path_factory.mktemp("size")
    customers(spark, path, 3000, 1)
    spark.range(2000).selectExpr("id AS s_suppkey", "concat('Supplier#', id) AS s_name").coalesce(1).write.parquet(f"{path}/supplier.parquet")
    lines = spark.range(100 * DAYS).selectExpr("id % 100 AS l_suppkey", f"date_add(DATE'2000-01-01', CAST(id DIV 100 AS INT)) AS l_shipdate", "CAST(id * 37 % 50 AS DOUBLE) AS l_quantity", "id * 7 % 900 AS l_partkey")
    lines.coalesce(1).write.parquet(f"{path}/lineitem.parquet")
    spark.range(25).selectExpr("CAST(id AS INT) AS n_nationkey", "CAST(id % 5 AS INT) AS n_regionkey").coalesce(1).write.parquet(f"{path}/nation.parquet")
    return str(path)


def shuffled_rows(spark, df):
    """Rows that the stages of a run write for others."""
    sc = spark.sparkContext

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = max(stages(), default=-1)
    df().write.format("noop").mode("overwrite").save()
    return sum(n for k, n in stages().items() if k > before)


@pytest.mark.parametrize("name", ["point_bilinear", "merge_both", "merge_chirps", "variable_timeseries", "icasa_rows", "icasa_site", "icasa_content", "icasa_package"])
def test_days_of_points_are_not_shuffled(spark, folder, name):
    assert shuffled_rows(spark, lambda: plans.queries()[name](spark, folder)) < 150_000


def test_series_of_points_are_written_by_cell(spark, folder, tmp_path):
    plans.queries()["points_nearest_join"](spark, folder).write.parquet(str(tmp_path / "out"))
    size = sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3000 * DAYS and size < 3 * 3000 * DAYS


def test_totals_by_cell_are_those_of_the_days(spark):
    places = spark.range(300).selectExpr("id AS point_seq", "(id * 37 % 600 - 300) / 1000D AS lat", "30 + (id * 53 % 600) / 1000D AS lon")
    grid = spark.range(100 * 30).selectExpr("CAST(id % 100 DIV 10 AS INT) lat_idx", "CAST(id % 10 AS INT) lon_idx", "date_add(DATE'2000-01-01', CAST(id DIV 100 AS INT)) obs_date", "CASE WHEN id % 41 > 0 THEN id % 97 / 8D END v")
    days = P.pixel_value(places, grid, FINE, "v").groupBy("point_seq").agg(F.count(F.lit(1)).alias("n_days"), F.sum("v").alias("total"))
    assert sorted(days.collect()) == sorted(P.pixel_totals(places, grid, FINE, "v").collect())
    found = {r["point_seq"]: r for r in P.bilinear_mean(places, grid, FINE, "v", ["obs_date"]).collect()}
    values = P.bilinear_join(places, grid, FINE, "v", ["obs_date"]).groupBy("point_seq").agg(F.count("v").alias("n_days"), F.avg("v").alias("mean")).collect()
    assert len(found) == len(values) > 100
    for r in values:
        assert found[r["point_seq"]]["n_days"] == r["n_days"] and found[r["point_seq"]]["mean"] == pytest.approx(r["mean"], abs=1e-9)


def test_pixel_totals_take_every_day_of_every_point(spark, folder, monkeypatch):
    days, taken = Observation("days"), P.pixel_value
    monkeypatch.setattr(P, "pixel_value", lambda *a: taken(*a).observe(days, F.count(F.lit(1)).alias("n")))
    rows = plans.queries()["pixel_value"](spark, folder).collect()
    assert len(rows) > 2000 and {r["n_days"] for r in rows} == {DAYS}
    assert days.get["n"] == len(rows) * DAYS


def test_pixel_totals_of_points_that_come_again(spark):
    """One row per number, as the query's SQL groups by it: points of a number may repeat, lie elsewhere, or have no number."""
    at = [(1, 0.21, 30.01), (1, 0.21, 30.01), (1, 0.11, 30.01), (None, 0.21, 30.01), (None, 0.11, 30.01), (2, None, 30.01), (3, 5.0, 30.01)]
    places = spark.createDataFrame(at, "point_seq long, lat double, lon double")
    grid = spark.sql("SELECT * FROM VALUES (0, 0, DATE'2000-01-01', 1.5D), (0, 0, DATE'2000-01-02', NULL), (2, 0, DATE'2000-01-01', 4D) AS g(lat_idx, lon_idx, obs_date, v)")
    found = {r["point_seq"]: (r["n_days"], r["total"]) for r in P.pixel_totals(places, grid, FINE, "v").collect()}
    assert found == {1: (5, 7.0), None: (3, 5.5)}


def test_a_place_with_many_points_is_dealt_in_blocks(spark):
    places = spark.range(12 * P.BLOCK).selectExpr("id AS point_seq", "id DIV 1000000 AS k")
    found = P.spread(places, spark.range(3).selectExpr("id DIV 1000000 AS k", "id AS day"), ["k"])
    assert found.select(F.spark_partition_id()).distinct().count() > 1
    assert found.groupBy("point_seq").agg(F.count_distinct("day").alias("n")).where("n = 3").count() == 12 * P.BLOCK


def test_package_of_more_sites_than_an_upload_may_have(spark, folder):
    rows = plans.queries()["package_job"](spark, folder).collect()
    # point_seq 0 to 599 have the places; those divisible by 97 are invalid, and later ones of the same remainder stand in
    assert {r["point_seq"] % 600 for r in rows if r["kind"] == "file"} == set(range(600))


def test_files_of_one_partition_are_written_by_many_tasks(spark, tmp_path):
    files = spark.range(40, numPartitions=1).selectExpr("lpad(CAST(id AS STRING), 3, '0') AS file_name", "concat('a', chr(10), id) AS content")
    export.write_package(files, str(tmp_path / "package"))
    assert len({f.name.split("-")[1] for f in (tmp_path / "package").glob("*/part-*")}) > 1
    assert sorted(map(tuple, export.read_package(spark, str(tmp_path / "package")).collect())) == sorted(map(tuple, files.collect()))
