"""Queries over the daily grid: selections, statistics, resampling, state."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwx import catalog
from gridwx.functions import values as V
from gridwx.operators import aggregate as A
from gridwx.operators import resample as R
from gridwx.operators import select as S
from gridwx.operators import state as T
from gridwx.plans.registry import FINE, FIRST, LAST, query
from gridwx.sources import tables

CELLS = "cell_id, lat_idx, lon_idx, latitude, longitude, obs_date, precipitation"
COLUMNS = CELLS.split(", ")


def rounded(df, *columns, digits=4):
    """Aggregates of doubles with four decimals, so that the order of summing does not show."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def sql_rounded(*columns):
    return ", ".join(f"round({c}, 4) AS {c}" for c in columns)


@query("grid_daily", f"SELECT {CELLS} FROM fx_grid_daily")
def grid_scan(spark, sf_dir, grid):
    return grid.select(*COLUMNS)


@query("grid_daily", f"SELECT {CELLS} FROM fx_grid_daily WHERE obs_date = DATE '1998-03-05'")
def single_date(spark, sf_dir, grid):
    return S.single_date(grid, "1998-03-05").select(*COLUMNS)


@query("grid_daily", f"SELECT {CELLS} FROM fx_grid_daily WHERE obs_date BETWEEN DATE '{FIRST}' AND DATE '{LAST}'")
def date_range(spark, sf_dir, grid):
    return S.date_range(grid, FIRST, LAST).select(*COLUMNS)


@query("grid_daily", f"SELECT {CELLS} FROM fx_grid_daily WHERE latitude BETWEEN -0.1e0 AND 0.1e0 AND longitude BETWEEN 30.1e0 AND 30.3e0 AND obs_date BETWEEN DATE '{FIRST}' AND DATE '{LAST}'")
def bbox_subset(spark, sf_dir, grid):
    return S.bbox(grid, 0.1, -0.1, 30.1, 30.3, FIRST, LAST, FINE).select(*COLUMNS)


NEAR_ROW = "greatest(0, least(9, ceil((0.225e0 - {}) / 0.05e0 - 0.5e0)))"
NEAR_COLUMN = "greatest(0, least(9, floor(({} - 30.025e0) / 0.05e0 + 0.5e0)))"


@query(
    "grid_daily points",
    f""", b AS (SELECT min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS d FROM fx_points WHERE lat BETWEEN -0.1e0 AND 0.1e0 AND lon BETWEEN 30.1e0 AND 30.3e0)
    SELECT {CELLS} FROM fx_grid_daily, b WHERE lat_idx BETWEEN {NEAR_ROW.format("b")} AND {NEAR_ROW.format("a")} AND lon_idx BETWEEN {NEAR_COLUMN.format("c")} AND {NEAR_COLUMN.format("d")}""",
)
def subset_bbox(spark, sf_dir, grid, points):
    """The cells around a set of points, written once for repeated reads."""
    near = points.where("lat BETWEEN -0.1D AND 0.1D AND lon BETWEEN 30.1D AND 30.3D")
    return S.local_subset(grid, A.points_bounds(near), FINE).select(*COLUMNS)


@query("grid_daily regions", f"SELECT region, {CELLS} FROM fx_grid_daily JOIN fx_regions ON latitude BETWEEN lat_min AND lat_max AND longitude BETWEEN lon_min AND lon_max WHERE region IN ('south', 'empty')")
def region_subset(spark, sf_dir, grid, regions):
    inside = F.col("latitude").between(F.col("lat_min"), F.col("lat_max")) & F.col("longitude").between(F.col("lon_min"), F.col("lon_max"))
    named = regions.where(F.col("region").isin("south", "empty"))
    return grid.join(F.broadcast(named), inside).select("region", *COLUMNS)


@query("grid_daily", "SELECT lat_idx, lon_idx, round(avg(precipitation), 4) AS mean FROM fx_grid_daily WHERE latitude BETWEEN -0.05e0 AND 0.15e0 AND longitude BETWEEN 30.1e0 AND 30.3e0 GROUP BY ALL")
def spatial_mean_map(spark, sf_dir, grid):
    return rounded(A.temporal_mean(S.around(grid, 0.05, 30.2, 0.1, FINE)), "mean")


@query("grid_daily", f"SELECT {CELLS} FROM fx_grid_daily WHERE lat_idx = 3 AND lon_idx = 9")
def point_nearest(spark, sf_dir, grid):
    return S.nearest_cell(grid, FINE, 0.066, 99.0).select(*COLUMNS)


@query(
    "grid_daily",
    "SELECT CAST(date_trunc('month', obs_date) + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) AS bin, round_even(avg(precipitation), 1) AS precipitation FROM fx_grid_daily WHERE lat_idx = 5 AND lon_idx = 4 AND obs_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' GROUP BY 1",
)
def point_timeseries(spark, sf_dir, grid):
    cell = S.date_range(S.box_centre_cell(grid, FINE, -0.2, 0.13, 30.1, 30.34), "1996-01-01", LAST)
    return R.resample(cell, "monthly", [], ["precipitation"]).withColumn("precipitation", V.round1(F.col("precipitation"), "np64"))


@query("grid_daily", f"SELECT {CELLS} FROM fx_grid_daily WHERE lat_idx >= 2 AND lat_idx < 6 AND lon_idx >= 1 AND lon_idx < 6")
def pixel_window(spark, sf_dir, grid):
    return S.pixel_window(grid, FINE, -0.07, 0.13, 30.07, 30.32).select(*COLUMNS)


@query("grid_daily", "SELECT cell_id, obs_date, raw_value, CASE WHEN NOT isnan(raw_value) AND raw_value NOT IN (-99e0, -9999e0) THEN raw_value END AS value FROM fx_grid_daily")
def null_normalize(spark, sf_dir, grid):
    return grid.select("cell_id", "obs_date", "raw_value", V.missing_to_null(F.col("raw_value")).alias("value"))


@query("grid_daily", f"SELECT {CELLS} FROM fx_grid_daily ORDER BY md5(CAST(cell_id AS VARCHAR) || '|' || CAST(obs_date AS VARCHAR)), cell_id, obs_date LIMIT 20")
def cell_sample(spark, sf_dir, grid):
    return S.cell_sample(grid, 20, "cell_id", "obs_date").select(*COLUMNS)


@query("grid_daily", "SELECT CAST(date_trunc('month', max(obs_date)) AS DATE) AS first_day, CAST(last_day(max(obs_date)) AS DATE) AS last_day FROM fx_grid_daily")
def latest_month(spark, sf_dir, grid):
    return S.latest_month(grid)


@query("other_source", "SELECT cell_id, obs_date, source1 FROM fx_other_source WHERE obs_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-07'")
def named_range(spark, sf_dir, other):
    return S.named_range(other, "one_week").select("cell_id", "obs_date", "source1")


@query(
    "grid_daily",
    """SELECT min(obs_date) AS ds_start, max(obs_date) AS ds_end, DATE '2000-06-01' <= max(obs_date) AND DATE '2010-01-01' >= min(obs_date) AS overlaps,
    greatest(DATE '2000-06-01', min(obs_date)) AS clip_start, least(DATE '2010-01-01', max(obs_date)) AS clip_end FROM fx_grid_daily""",
)
def range_overlap(spark, sf_dir, grid):
    return S.range_overlap(grid, "2000-06-01", "2010-01-01")


PARAMETERS = "CONCAT(' rain, t2m ,', CASE WHEN c_custkey % 3 = 0 THEN 'rain1' ELSE 'tmax' END, ',bad', CAST(c_custkey % 4 AS STRING), ', rain')"


@query(
    "",
    f""", r AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'both' ELSE 'chirps' END AS rain_source, list_transform(string_split({PARAMETERS.replace('STRING', 'VARCHAR')}, ','), lambda x: upper(trim(x))) AS p FROM customer),
    s AS (SELECT *, list_filter(p, lambda x, i: x <> '' AND list_position(p, x) = i) AS sel FROM r)
    SELECT c_custkey, array_to_string(sel, ',') AS selected, array_to_string(list_filter(sel, lambda x: x LIKE 'BAD%'), ',') AS invalid, array_to_string(list_filter(sel, lambda x: x NOT LIKE 'BAD%'), ',') AS usable,
    list_contains(sel, 'RAIN1') AND rain_source <> 'both' AS rain1_needs_both FROM s""",
)
def parse_parameters(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey", f"{PARAMETERS} AS csv", "CASE WHEN c_custkey % 2 = 0 THEN 'both' ELSE 'chirps' END AS rain_source")
    allowed = [code for code, *_ in catalog.VARIABLES]
    parsed = rows.select("c_custkey", *S.parse_parameters(F.col("csv"), allowed, F.col("rain_source")))
    return parsed.withColumns({c: F.array_join(c, ",") for c in ("selected", "invalid", "usable")})


@query("grid_daily", "SELECT lat_idx, lon_idx, round(avg(precipitation), 4) AS mean FROM fx_grid_daily GROUP BY ALL")
def temporal_mean(spark, sf_dir, grid):
    return rounded(A.temporal_mean(grid), "mean")


@query("grid_daily", f"SELECT lat_idx, lon_idx, round(coalesce(sum(precipitation), 0), 4) AS total FROM fx_grid_daily WHERE obs_date BETWEEN DATE '{FIRST}' AND DATE '{LAST}' GROUP BY ALL")
def temporal_sum(spark, sf_dir, grid):
    return rounded(A.temporal_sum(S.date_range(grid, FIRST, LAST)), "total")


@query("grid_daily", "SELECT round(avg(precipitation), 4) AS mean FROM fx_grid_daily WHERE obs_date = DATE '1998-03-05'")
def spatial_mean(spark, sf_dir, grid):
    return rounded(A.spatial_mean(grid.where("obs_date = DATE'1998-03-05'")), "mean")


@query("grid_daily", "SELECT obs_date, round(avg(precipitation), 4) AS mean, count(DISTINCT lat_idx) * count(DISTINCT lon_idx) AS grid_cells FROM fx_grid_daily WHERE latitude BETWEEN -0.15e0 AND 0.15e0 AND longitude BETWEEN 30.1e0 AND 30.4e0 GROUP BY obs_date")
def area_average(spark, sf_dir, grid):
    return rounded(A.area_average(S.bbox(grid, -0.15, 0.15, 30.1, 30.4, spec=FINE)), "mean")


@query(
    "grid_daily regions",
    """SELECT region, round(avg(precipitation), 4) AS mean, round(stddev_pop(precipitation), 4) AS std, min(precipitation) AS min, max(precipitation) AS max, round(coalesce(sum(precipitation), 0), 4) AS sum, count(precipitation) AS n_values
    FROM fx_grid_daily JOIN fx_regions ON latitude BETWEEN lat_min AND lat_max AND longitude BETWEEN lon_min AND lon_max GROUP BY region""",
)
def region_stats(spark, sf_dir, grid, regions):
    return rounded(A.region_stats(grid, regions), "mean", "std", "sum")


WET_NAMES = ["all_total", "all_mean", "all_median", "all_max", "all_min", "all_std", "wet_total", "wet_mean", "wet_median", "wet_max", "wet_min", "wet_std"]


@query(
    "grid_daily",
    """, r AS (SELECT cell_id, CAST(CAST(round_even(CAST(precipitation AS FLOAT) * CAST(10 AS FLOAT), 0) / CAST(10 AS FLOAT) AS FLOAT) AS DOUBLE) AS v FROM fx_grid_daily),
    w AS (SELECT *, v >= CAST(CAST(0.1 AS FLOAT) AS DOUBLE) AS wet FROM r)
    SELECT cell_id, round(coalesce(sum(v), 0), 4) AS all_total, round(avg(v), 4) AS all_mean, round(quantile_cont(v, 0.5), 4) AS all_median, round(max(v), 4) AS all_max, round(min(v), 4) AS all_min, round(stddev_pop(v), 4) AS all_std,
    count(v) FILTER (wet) AS wet_days, count(v) - count(v) FILTER (wet) AS dry_days, round(coalesce(sum(v) FILTER (wet), 0), 4) AS wet_total, round(coalesce(avg(v) FILTER (wet), 0), 4) AS wet_mean,
    round(coalesce(quantile_cont(v, 0.5) FILTER (wet), 0), 4) AS wet_median, round(coalesce(max(v) FILTER (wet), 0), 4) AS wet_max, round(coalesce(min(v) FILTER (wet), 0), 4) AS wet_min, round(coalesce(stddev_pop(v) FILTER (wet), 0), 4) AS wet_std
    FROM w GROUP BY cell_id""",
)
def wet_dry_stats(spark, sf_dir, grid):
    return rounded(A.wet_dry_stats(grid, ["cell_id"]), *WET_NAMES)


LONG = "stack(4, 'RAIN1', prectotcorr, 'T2M', t2m, 'RH2M', rh2m, 'WIND', ws2m) AS (code, value)"
LONG_SQL = "SELECT 'RAIN1' AS code, prectotcorr AS value FROM fx_met_daily UNION ALL SELECT 'T2M', t2m FROM fx_met_daily UNION ALL SELECT 'RH2M', rh2m FROM fx_met_daily UNION ALL SELECT 'WIND', ws2m FROM fx_met_daily"


@query(
    "met_daily",
    f""", l AS ({LONG_SQL}), r AS (SELECT code, CAST(floor(value * 10 + 0.5e0) AS DOUBLE) / 10 AS v FROM l WHERE value IS NOT NULL), w AS (SELECT *, code <> 'RAIN1' OR v >= 0.1e0 AS wet FROM r)
    SELECT code, CASE WHEN code = 'RAIN1' THEN round(sum(v), 4) END AS total, round(avg(v), 4) AS mean, round(quantile_cont(v, 0.5), 4) AS median, max(v) AS max, min(v) AS min, round(stddev_pop(v), 4) AS std, count(*) FILTER (wet) AS wet_days,
    count(*) FILTER (NOT wet) AS dry_days, round(avg(v) FILTER (wet), 4) AS wet_mean, CASE WHEN code = 'RAIN1' THEN round(100e0 * count(*) FILTER (wet) / count(*), 4) END AS rain_pct FROM w GROUP BY code""",
)
def variable_stats(spark, sf_dir, met):
    return rounded(A.variable_stats(met.selectExpr(LONG), ["RAIN", "RAIN1"]), "total", "mean", "median", "std", "wet_mean", "rain_pct")


@query(
    "grid_daily",
    """SELECT obs_date, round(avg(precipitation), 4) AS mean, min(precipitation) AS min, max(precipitation) AS max, round(stddev_pop(precipitation), 4) AS std, count(precipitation) AS valid, count(*) AS cells,
    round(100e0 * count(precipitation) / count(*), 4) AS valid_pct, round(quantile_cont(precipitation, 0.25), 6) AS p25, round(quantile_cont(precipitation, 0.5), 6) AS median, round(quantile_cont(precipitation, 0.75), 6) AS p75, round(quantile_cont(precipitation, 0.95), 6) AS p95
    FROM fx_grid_daily GROUP BY obs_date""",
)
def daily_grid_summary(spark, sf_dir, grid):
    return rounded(rounded(A.daily_grid_summary(grid), "mean", "std", "valid_pct"), "p25", "median", "p75", "p95", digits=6)


@query(
    "grid_daily",
    "SELECT level, round(value, 4) AS value FROM (" + " UNION ALL ".join(f"SELECT CAST({q} AS INTEGER) AS level, quantile_cont(precipitation, {q / 100}) AS value FROM fx_grid_daily" for q in (0, 10, 25, 50, 75, 90, 95, 99, 100)) + ")",
)
def percentile_profile(spark, sf_dir, grid):
    return rounded(A.percentile_profile(grid), "value")


@query(
    "grid_daily",
    """, d AS (SELECT obs_date, avg(precipitation) AS m, max(precipitation) AS x, 100e0 * count(precipitation) / count(*) AS p FROM fx_grid_daily GROUP BY obs_date)
    SELECT round(avg(m), 4) AS mean_of_means, round(stddev_samp(m), 4) AS std_of_means, round(min(m), 4) AS min_mean, (SELECT min(obs_date) FROM d WHERE m = (SELECT min(m) FROM d)) AS min_date, round(max(m), 4) AS max_mean,
    (SELECT min(obs_date) FROM d WHERE m = (SELECT max(m) FROM d)) AS max_date, max(x) AS global_max, round(avg(p), 4) AS mean_coverage FROM d""",
)
def daily_mean_extremes(spark, sf_dir, grid):
    return rounded(A.daily_mean_extremes(grid), "mean_of_means", "std_of_means", "min_mean", "max_mean", "mean_coverage")


@query(
    "grid_daily",
    """, e AS (SELECT min(precipitation) AS lo, max(precipitation) AS hi FROM fx_grid_daily)
    SELECT CAST(CASE WHEN hi > lo THEN least(50, floor((precipitation - lo) / ((hi - lo) / 50)) + 1) ELSE 1 END AS INTEGER) AS bin, count(*) AS n FROM fx_grid_daily, e WHERE precipitation IS NOT NULL GROUP BY 1""",
)
def histogram(spark, sf_dir, grid):
    return A.histogram(grid)


@query(
    "grid_daily",
    """, r AS (SELECT least(lat_idx, 9) AS band, precipitation AS v FROM fx_grid_daily WHERE precipitation IS NOT NULL),
    q AS (SELECT band, count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM r GROUP BY band)
    SELECT CAST(q.band AS INTEGER) AS band, n, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, min(v) AS low, max(v) AS high FROM q JOIN r ON r.band = q.band AND v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL""",
)
def latitude_bands(spark, sf_dir, grid):
    return rounded(A.latitude_bands(grid, 10), "q1", "median", "q3")


@query(
    "grid_daily",
    """, d AS (SELECT DISTINCT precipitation AS value FROM fx_grid_daily WHERE precipitation IS NOT NULL)
    SELECT value, side, (SELECT count(*) FROM d) AS n_distinct FROM ((SELECT value, 'first' AS side FROM d ORDER BY value LIMIT 10) UNION ALL (SELECT value, 'last' FROM d ORDER BY value DESC LIMIT 10))""",
)
def distinct_values(spark, sf_dir, grid):
    return A.distinct_values(grid)


@query(
    "grid_daily",
    """SELECT obs_date, count(DISTINCT lat_idx) AS n_rows, count(DISTINCT lon_idx) AS n_cols, count(precipitation) AS valid, round(100e0 * count(precipitation) / count(*), 4) AS valid_pct, min(precipitation) AS min, max(precipitation) AS max,
    round(avg(precipitation), 4) AS mean, round(stddev_pop(precipitation), 4) AS std, round(quantile_cont(precipitation, 0.25), 6) AS p25, round(quantile_cont(precipitation, 0.5), 6) AS median, round(quantile_cont(precipitation, 0.75), 6) AS p75,
    round(quantile_cont(precipitation, 0.9), 6) AS p90, round(quantile_cont(precipitation, 0.95), 6) AS p95 FROM fx_grid_daily WHERE lat_idx >= 2 AND lat_idx < 6 AND lon_idx >= 1 AND lon_idx < 6 GROUP BY obs_date""",
)
def region_day_stats(spark, sf_dir, grid):
    window = S.pixel_window(grid, FINE, -0.07, 0.13, 30.07, 30.32)
    return rounded(rounded(A.region_day_stats(window), "valid_pct", "mean", "std"), "p25", "median", "p75", "p90", "p95", digits=6)


@query("grid_daily", "SELECT lat_idx, lon_idx, CAST(month(obs_date) AS INTEGER) AS month, round(avg(precipitation), 4) AS mean FROM fx_grid_daily GROUP BY ALL")
def climatology(spark, sf_dir, grid):
    return rounded(A.climatology(grid), "mean")


@query(
    "grid_daily",
    f"""SELECT lat_idx, lon_idx, round(avg(precipitation) FILTER (obs_date BETWEEN DATE '{FIRST}' AND DATE '{LAST}') - avg(precipitation), 4) AS anomaly FROM fx_grid_daily GROUP BY ALL
    HAVING count(*) FILTER (obs_date BETWEEN DATE '{FIRST}' AND DATE '{LAST}') > 0""",
)
def anomaly(spark, sf_dir, grid):
    return rounded(A.anomaly(A.temporal_mean(S.date_range(grid, FIRST, LAST)), A.temporal_mean(grid)), "anomaly")


@query(
    "grid_daily",
    """SELECT lat_idx, CAST(CASE WHEN lat_idx % 2 = 0 THEN -9999 ELSE 0 END AS DOUBLE) AS declared_min, CAST(6.25 AS DOUBLE) AS declared_max, min(raw_value) AS computed_min, max(raw_value) AS computed_max,
    min(raw_value) = CASE WHEN lat_idx % 2 = 0 THEN -9999 ELSE 0 END AND max(raw_value) = 6.25 AS same FROM fx_grid_daily GROUP BY lat_idx""",
)
def declared_vs_computed(spark, sf_dir, grid):
    declared = grid.select("lat_idx").distinct().selectExpr("lat_idx", "CAST(CASE WHEN lat_idx % 2 = 0 THEN -9999 ELSE 0 END AS DOUBLE) AS declared_min", "CAST(6.25 AS DOUBLE) AS declared_max")
    return A.declared_vs_computed(declared, grid, "lat_idx", "raw_value")


@query("solar_daily", "SELECT bucket, CAST(year(obs_date) AS INTEGER) AS year, min(obs_date) AS first_day, max(obs_date) AS last_day, count(DISTINCT obs_date) AS n_days FROM fx_solar_daily GROUP BY 1, 2")
def availability_by_year(spark, sf_dir, solar):
    return A.availability_by_year(solar, "bucket")


@query("grid_daily", f"SELECT count(*) AS n, CAST(0 AS DOUBLE) AS max_difference, true AS all_close FROM fx_grid_daily WHERE lat_idx = 4 AND lon_idx = 3 AND obs_date BETWEEN DATE '1998-01-01' AND DATE '{LAST}'")
def series_equal(spark, sf_dir, grid):
    cell_first = S.date_range(S.nearest_cell(grid, FINE, 0.02, 30.18), "1998-01-01", LAST)
    days_first = S.nearest_cell(S.date_range(grid, "1998-01-01", LAST), FINE, 0.02, 30.18)
    return A.series_equal(cell_first, days_first, ["obs_date"], "precipitation")


@query("grid_daily", "SELECT CAST(floor(latitude / 0.25e0) AS INTEGER) AS lat_cell, CAST(floor(longitude / 0.25e0) AS INTEGER) AS lon_cell, round(avg(precipitation), 4) AS mean FROM fx_grid_daily GROUP BY ALL")
def coarsen(spark, sf_dir, grid):
    return rounded(A.coarsen(grid, 0.25), "mean")


@query("grid_daily", "SELECT cell_id, obs_date, round(log10(precipitation + 0.01e0), 4) AS log_value FROM fx_grid_daily")
def log_scale(spark, sf_dir, grid):
    return grid.select("cell_id", "obs_date", F.round(A.log_scale(F.col("precipitation")), 4).alias("log_value"))


def _resampled(every, label):
    def run(spark, sf_dir, grid):
        return rounded(R.resample(grid, every, ["cell_id"], ["precipitation"]), "precipitation")

    run.__name__ = f"resample_{every}"
    return query("grid_daily", f"SELECT cell_id, {label} AS bin, round(avg(precipitation), 4) AS precipitation FROM fx_grid_daily GROUP BY ALL")(run)


WEEK = "CAST(date_trunc('week', obs_date) + INTERVAL 6 DAY AS DATE)"
_resampled("weekly", WEEK)
_resampled("monthly", "CAST(last_day(obs_date) AS DATE)")
_resampled("yearly", "make_date(year(obs_date), 12, 31)")


@query(
    "grid_daily",
    f""", r AS (SELECT cell_id, {WEEK} AS bin, avg(precipitation) AS m FROM fx_grid_daily GROUP BY ALL),
    s AS (SELECT cell_id, CAST(unnest(generate_series(min(bin), max(bin), INTERVAL 7 DAY)) AS DATE) AS bin FROM r GROUP BY cell_id)
    SELECT s.cell_id, s.bin, round(m, 4) AS precipitation FROM s LEFT JOIN r ON r.cell_id = s.cell_id AND r.bin = s.bin""",
)
def resample_gapfilled(spark, sf_dir, grid):
    return rounded(R.resample_gapfilled(grid, "weekly", ["cell_id"], ["precipitation"]), "precipitation")


@query("grid_daily", "SELECT cell_id, CAST(year(obs_date) AS INTEGER) AS year, round(coalesce(sum(precipitation), 0), 4) AS total FROM fx_grid_daily WHERE month(obs_date) IN (3, 4, 5) GROUP BY 1, 2")
def seasonal_sum(spark, sf_dir, grid):
    return rounded(R.seasonal_sum(grid, [3, 4, 5], ["cell_id"]), "total")


@query("manifest", ", s AS (SELECT CAST(unnest(generate_series(DATE '1996-12-25', DATE '1997-01-10', INTERVAL 1 DAY)) AS DATE) AS obs_date) SELECT s.obs_date, status FROM s LEFT JOIN fx_manifest USING (obs_date)")
def day_spine(spark, sf_dir, manifest):
    return T.day_spine("1996-12-25", "1997-01-10", manifest.select("obs_date", F.col("status").cast("int").alias("status")))


SPINE = ", s AS (SELECT CAST(unnest(generate_series((SELECT min(obs_date) FROM fx_manifest), (SELECT max(obs_date) FROM fx_manifest), INTERVAL 1 DAY)) AS DATE) AS obs_date), m AS (SELECT obs_date FROM s WHERE obs_date NOT IN (SELECT obs_date FROM fx_manifest))"


@query("manifest", SPINE + " SELECT obs_date FROM m")
def missing_dates(spark, sf_dir, manifest):
    return T.missing_dates(manifest)


@query("manifest grid_daily", "SELECT obs_date FROM fx_manifest WHERE obs_date IN (SELECT obs_date FROM fx_grid_daily)")
def date_exists(spark, sf_dir, manifest, grid):
    return T.date_exists(manifest.select("obs_date"), grid)


@query("manifest", SPINE + ", g AS (SELECT obs_date, obs_date - CAST(row_number() OVER (ORDER BY obs_date) AS INTEGER) AS k FROM m) SELECT min(obs_date) AS gap_start, max(obs_date) AS gap_end, CAST(count(*) AS INTEGER) AS n_days FROM g GROUP BY k")
def gap_islands(spark, sf_dir, manifest):
    return T.gap_islands(manifest)


COVERAGE = """SELECT min(obs_date) AS earliest, max(obs_date) AS latest, count(DISTINCT obs_date) AS total_days, CAST(max(obs_date) - min(obs_date) + 1 AS BIGINT) AS expected_days, CAST(max(obs_date) - min(obs_date) + 1 AS BIGINT) - count(DISTINCT obs_date) AS missing_days,
    round(100e0 * count(DISTINCT obs_date) / (max(obs_date) - min(obs_date) + 1), 4) AS coverage_pct, max(obs_date) - min(obs_date) + 1 > count(DISTINCT obs_date) AS has_gaps, CAST(max(obs_date) + 1 AS DATE) AS next_day FROM fx_manifest"""


@query("manifest", COVERAGE)
def coverage_stats(spark, sf_dir, manifest):
    return rounded(T.coverage_stats(manifest), "coverage_pct")


@query("manifest", "SELECT max(obs_date) AS latest, CAST(greatest(0, DATE '2001-09-01' - max(obs_date)) AS INTEGER) AS days_behind, CASE WHEN DATE '2001-09-01' - max(obs_date) > 31 THEN 'CRITICAL' WHEN DATE '2001-09-01' - max(obs_date) > 7 THEN 'WARNING' ELSE 'OK' END AS state FROM fx_manifest")
def freshness(spark, sf_dir, manifest):
    return T.freshness(manifest, "2001-09-01")


@query("manifest", ", w AS (SELECT lag(obs_date) OVER (ORDER BY path) AS before, obs_date FROM fx_manifest) SELECT before, obs_date, CAST(obs_date - before AS INTEGER) AS step, CASE WHEN obs_date <= before THEN 'order' ELSE 'gap' END AS problem FROM w WHERE obs_date - before <> 1")
def sequence_check(spark, sf_dir, manifest):
    return T.sequence_check(manifest, "path")


@query(
    "manifest",
    """, d AS (SELECT CAST(DATE '1995-01-01' + CAST(i AS INTEGER) AS DATE) AS obs_date FROM range(500) t(i)), b AS (SELECT min(obs_date) AS stop FROM d WHERE obs_date NOT IN (SELECT obs_date FROM fx_manifest WHERE status = 200))
    SELECT obs_date FROM d, b WHERE stop IS NULL OR obs_date < stop""",
)
def available_prefix(spark, sf_dir, manifest):
    return T.available_prefix(manifest, "1995-01-01", 500)


@query("grid_daily", "SELECT obs_date, row_number() OVER (ORDER BY obs_date) - 1 AS time_index FROM (SELECT DISTINCT obs_date FROM fx_grid_daily)")
def time_index(spark, sf_dir, grid):
    return T.time_index(grid)


@query(
    "manifest",
    """, s AS (SELECT CAST(unnest(generate_series(DATE '1996-01-01', DATE '1997-12-31', INTERVAL 1 DAY)) AS DATE) AS obs_date)
    SELECT s.obs_date, f.path, f.path IS NOT NULL AS found FROM s LEFT JOIN (SELECT * FROM fx_manifest WHERE status = 200 AND size_bytes > 0) f ON f.obs_date = s.obs_date""",
)
def files_for_dates(spark, sf_dir, manifest):
    return T.files_for_dates(manifest, "1996-01-01", "1997-12-31")


@query("grid_daily", """, l AS (SELECT DISTINCT latitude FROM fx_grid_daily), s AS (SELECT latitude - lag(latitude) OVER (ORDER BY latitude) AS step FROM l)
    SELECT min(obs_date) AS first_day, max(obs_date) AS last_day, count(DISTINCT obs_date) AS n_days, min(latitude) AS lat_min, max(latitude) AS lat_max, min(longitude) AS lon_min, max(longitude) AS lon_max, (SELECT round(min(step), 4) FROM s) AS resolution FROM fx_grid_daily""")
def grid_metadata(spark, sf_dir, grid):
    return rounded(tables.grid_metadata(grid), "resolution")


@query(
    "grid_daily",
    """, e AS (SELECT min(latitude) AS a, max(latitude) AS b, min(longitude) AS c, max(longitude) AS d, min(obs_date) AS e, max(obs_date) AS f FROM fx_grid_daily)
    SELECT unnest(['title', 'institution', 'source', 'references', 'comment', 'geospatial_lat_min', 'geospatial_lat_max', 'geospatial_lon_min', 'geospatial_lon_max', 'time_coverage_start', 'time_coverage_end']) AS key,
    unnest(['Daily precipitation', 'Unknown', 'Daily rasters', '', '', printf('%.4f', a), printf('%.4f', b), printf('%.4f', c), printf('%.4f', d), CAST(e AS VARCHAR), CAST(f AS VARCHAR)]) AS value FROM e""",
)
def dataset_meta(spark, sf_dir, grid):
    return tables.dataset_meta(grid)


@query("", "SELECT CAST(n_nationkey AS INTEGER) AS file_no, unnest(['title', 'institution', 'source', 'references', 'comment']) AS key, unnest([n_name, 'Unknown', CASE WHEN n_regionkey = 1 THEN 'Daily rasters' ELSE 'region ' || CAST(n_regionkey AS VARCHAR) END, '', '']) AS value FROM nation")
def dataset_attributes(spark, sf_dir):
    """The five attributes of metadata files: given ones, defaults for what a file lacks or has as null, others left out."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    source = F.when(F.col("n_regionkey") != 1, F.concat(F.lit("region "), F.col("n_regionkey").cast("string")))
    text = F.to_json(F.struct(F.col("n_name").alias("title"), source.alias("source"), F.lit("x").alias("unknown_key")), {"ignoreNullFields": "false"})
    found = tables.attributes(nations.select(F.col("n_nationkey").cast("int").alias("file_no"), text.alias("value")))
    return found.select("file_no", F.explode("attrs").alias("key", "value"))


@query("elevation", "SELECT lat_idx, lon_idx, CASE WHEN elev >= -430 AND elev <= 9000 THEN elev END AS elev FROM fx_elevation")
def elevation_clean(spark, sf_dir, elevation):
    return tables.clean_elevation(elevation).select("lat_idx", "lon_idx", "elev")


@query("", "SELECT event_type AS event, count(*) AS n, CAST(min(ts) AS DATE) AS first_day, CAST(max(ts) AS DATE) AS last_day FROM events GROUP BY 1")
def audit_summary(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return tables.audit_summary(events.select(F.col("event_type").alias("event"), F.to_date("ts").alias("obs_date")))


@query("")
def table_size(spark, sf_dir):
    return tables.table_size(spark, f"{sf_dir}/lineitem.parquet")


@query("grid_daily", "SELECT cell_id, obs_date, CASE WHEN precipitation IS NULL THEN NULL WHEN precipitation < 1 THEN 'dry' WHEN precipitation < 5 THEN 'light' WHEN precipitation < 20 THEN 'moderate' WHEN precipitation < 50 THEN 'heavy' ELSE 'veryHeavy' END AS category FROM fx_grid_daily")
def precip_category(spark, sf_dir, grid):
    return grid.select("cell_id", "obs_date", V.steps(F.col("precipitation"), V.PRECIPITATION, "veryHeavy").alias("category"))


@query("grid_daily", "SELECT cell_id, obs_date, CASE WHEN precipitation IS NULL THEN NULL WHEN precipitation / 24 <= 0 THEN 'no measurable rain' WHEN precipitation / 24 <= 2.5 THEN 'light rain' WHEN precipitation / 24 <= 7.6e0 THEN 'moderate rain' WHEN precipitation / 24 <= 50 THEN 'heavy rain' ELSE 'violent rain' END AS class FROM fx_grid_daily")
def rain_classes(spark, sf_dir, grid):
    return grid.select("cell_id", "obs_date", V.rain_class(F.col("precipitation")).alias("class"))


@query("grid_daily", "SELECT cell_id, obs_date, round_even(precipitation, 1) AS np64, CAST(printf('%.1f', precipitation * 0.4e0) AS DOUBLE) AS py, CAST(round_even(CAST(precipitation AS FLOAT) * CAST(10 AS FLOAT), 0) / CAST(10 AS FLOAT) AS FLOAT) AS np32, CAST(floor(precipitation * 10 + 0.5e0) AS DOUBLE) / 10 AS js FROM fx_grid_daily")
def round_one(spark, sf_dir, grid):
    """`py` over multiples of 0.05, of which half are printed as ties and few are."""
    p = F.col("precipitation")
    return grid.select("cell_id", "obs_date", V.round1(p, "np64").alias("np64"), V.round1(p * 0.4, "py").alias("py"), V.round1(p, "np32").alias("np32"), V.round1(p, "js").alias("js"))


@query(
    "manifest",
    """SELECT obs_date, strftime(obs_date, '%b %-d') AS daily, strftime(obs_date, '%b %Y') AS monthly, strftime(obs_date, '%Y') AS yearly FROM fx_manifest""",
)
def date_labels(spark, sf_dir, manifest):
    return manifest.select("obs_date", *[V.date_label(F.col("obs_date"), F.lit(a)).alias(a) for a in ("daily", "monthly", "yearly")])
