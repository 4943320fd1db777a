"""Tables stored by place: a request reads little more than it asks for, by the scan's own metrics."""

from pyspark.sql import functions as F

from gridwx.sources import daylog, tables

SIDE, TILE, DAYS = 200, 50, 30


def scanned_rows(df):
    """Rows that the Parquet reader hands on: those of pages and row groups that its filters could not skip."""
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))


def stored(spark, tmp_path):
    cells = spark.range(SIDE * SIDE * DAYS).selectExpr(
        f"CAST(id DIV {DAYS} DIV {SIDE} AS INT) lat_idx", f"CAST(id DIV {DAYS} % {SIDE} AS INT) lon_idx", f"DATE_ADD(DATE'2023-12-20', CAST(id % {DAYS} AS INT)) obs_date", "CAST(id AS FLOAT) precipitation"
    )
    daylog.create(spark, str(tmp_path / "days"), cells.repartition("obs_date"))
    tables.compact(spark, str(tmp_path / "days"), str(tmp_path / "tiles"), TILE, page_rows=1000)
    return str(tmp_path / "tiles"), cells


def test_box_of_a_hundredth_reads_at_most_three(spark, tmp_path):
    path, cells = stored(spark, tmp_path)
    total = SIDE * SIDE * DAYS
    assert spark.read.parquet(path).count() == total
    for rows, columns in (((64, 83), (110, 129)), ((0, 19), (0, 19)), ((150, 169), (20, 39))):
        box = tables.read_tiles(spark, path, rows, columns)
        assert box.count() == total // 100
        assert scanned_rows(box) <= 0.03 * total
    assert box.columns == cells.columns
    wanted = cells.where(F.col("lat_idx").between(150, 169) & F.col("lon_idx").between(20, 39))
    assert box.exceptAll(wanted).isEmpty() and wanted.exceptAll(box).isEmpty()


def test_boxes_over_several_tiles_and_days(spark, tmp_path):
    path, cells = stored(spark, tmp_path)
    box = tables.read_tiles(spark, path, (45, 54), (95, 104), "2023-12-31", "2024-01-01")
    assert sorted({str(r[0]) for r in box.select("obs_date").distinct().collect()}) == ["2023-12-31", "2024-01-01"] and box.count() == 200
    one = tables.read_tiles(spark, path, (7, 7), (9, 9), first="2024-01-01")
    assert one.count() == 18 and scanned_rows(one) <= 0.003 * SIDE * SIDE * DAYS
    assert tables.read_tiles(spark, path, (500, 600), (0, 9)).count() == 0
