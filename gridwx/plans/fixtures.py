"""Fixture views over the given tables, as SQL that Spark and DuckDB both run unchanged.

Each gives a table of the engine's data model; all numbers are multiples of 1/8 where possible, so that sums and means are
exact in binary.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("lineitem", "orders", "embeddings", "customer", "nation", "events", "supplier")

SQL = {}

SQL["fx_grid_daily"] = """
WITH g AS (
  SELECT CAST(l_suppkey % 100 AS INT) AS cell_id, CAST(l_shipdate AS DATE) AS obs_date,
         CAST(SUM(l_quantity) AS INT) AS q
  FROM lineitem GROUP BY 1, 2)
SELECT cell_id,
       CAST(FLOOR(cell_id / 10) AS INT) AS lat_idx,
       cell_id % 10 AS lon_idx,
       CAST(45 - 10 * CAST(FLOOR(cell_id / 10) AS INT) AS DOUBLE) / 200 AS latitude,
       CAST(6005 + 10 * (cell_id % 10) AS DOUBLE) / 200 AS longitude,
       obs_date,
       CASE WHEN q % 7 = 0 THEN CAST(-9999 AS DOUBLE) WHEN q % 3 = 0 THEN CAST(0 AS DOUBLE)
            ELSE CAST(q AS DOUBLE) / 8 END AS raw_value,
       CASE WHEN q % 7 = 0 THEN NULL WHEN q % 3 = 0 THEN CAST(0 AS DOUBLE)
            ELSE CAST(q AS DOUBLE) / 8 END AS precipitation
FROM g
"""

SQL["fx_met_daily"] = """
WITH c AS (
  SELECT CAST(FLOOR((l_suppkey % 100) / 50) AS INT) AS lat_idx,
         CAST(FLOOR((l_suppkey % 10) / 5) AS INT) AS lon_idx,
         CAST(l_shipdate AS DATE) AS obs_date, CAST(SUM(l_partkey) AS BIGINT) AS k
  FROM lineitem GROUP BY 1, 2, 3)
SELECT lat_idx, lon_idx,
       CAST(1 - 2 * lat_idx AS DOUBLE) / 8 AS lat, CAST(241 + 2 * lon_idx AS DOUBLE) / 8 AS lon, obs_date,
       CAST(k % 241 AS DOUBLE) / 8 - 2 AS t2m,
       CAST(k % 241 AS DOUBLE) / 8 + 3 + CAST(k % 5 AS DOUBLE) / 8 AS t2m_max,
       CAST(k % 241 AS DOUBLE) / 8 - 6 - CAST(k % 7 AS DOUBLE) / 8 AS t2m_min,
       CASE WHEN k % 4 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(k % 97 AS DOUBLE) / 8 END AS prectotcorr,
       CAST(k % 241 AS DOUBLE) / 8 - 5 AS t2mdew,
       CAST(k % 120 AS DOUBLE) / 8 AS ws2m,
       CASE WHEN k % 11 = 0 THEN NULL ELSE CAST(k % 801 AS DOUBLE) / 8 END AS rh2m
FROM c
"""

SQL["fx_solar_daily"] = """
WITH c AS (
  SELECT CAST(FLOOR((l_suppkey % 100) / 50) AS INT) AS lat_idx,
         CAST(FLOOR((l_suppkey % 10) / 5) AS INT) AS lon_idx,
         CAST(l_shipdate AS DATE) AS obs_date, CAST(SUM(l_orderkey) AS BIGINT) AS k
  FROM lineitem GROUP BY 1, 2, 3)
SELECT 'srb' AS bucket, lat_idx, lon_idx, obs_date,
       CASE WHEN k % 6 = 0 THEN NULL ELSE CAST(k % 3000 AS DOUBLE) / 8 END AS allsky_sfc_sw_dwn
FROM c WHERE obs_date < DATE '2001-02-01'
UNION ALL
SELECT 'syn1deg' AS bucket, lat_idx, lon_idx, obs_date,
       CASE WHEN k % 9 = 0 THEN NULL ELSE CAST((k + 8) % 3000 AS DOUBLE) / 8 END AS allsky_sfc_sw_dwn
FROM c WHERE obs_date >= DATE '2000-12-01'
"""

SQL["fx_manifest"] = """
SELECT CAST(o_orderdate AS DATE) AS obs_date,
       CONCAT('raster.v3.', REPLACE(CAST(CAST(o_orderdate AS DATE) AS STRING), '-', '.'), '.tif') AS path,
       CASE WHEN SUM(o_orderkey) % 400 = 0 THEN 404 ELSE 200 END AS status,
       COUNT(*) * 100 AS size_bytes
FROM orders GROUP BY CAST(o_orderdate AS DATE)
"""

SQL["fx_raster_tile"] = """
SELECT DATE '2024-01-01' + CAST(vec_id AS INT) AS obs_date, 8 AS width, 8 AS height,
       CASE WHEN vec_id % 50 = 49 THEN 'EPSG:4269' ELSE 'EPSG:4326' END AS crs,
       1 + CAST(vec_id % 97 = 0 AND vec_id > 0 AS INT) AS band_count, embedding AS pixel_values
FROM embeddings
"""

SQL["fx_points"] = """
SELECT c_custkey AS point_seq, c_name AS point_id,
       CASE WHEN c_custkey % 97 = 0 THEN CAST(200 AS DOUBLE)
            ELSE CAST((c_custkey * 37) % 600 - 300 AS DOUBLE) / 1000 END AS lat,
       CAST(30000 + (c_custkey * 53) % 600 AS DOUBLE) / 1000 AS lon
FROM customer
"""

SQL["fx_elevation"] = """
SELECT CAST(FLOOR(n_nationkey / 5) AS INT) AS lat_idx, n_nationkey % 5 AS lon_idx,
       CAST(20 - 10 * CAST(FLOOR(n_nationkey / 5) AS INT) AS DOUBLE) / 100 AS lat,
       CAST(3005 + 10 * (n_nationkey % 5) AS DOUBLE) / 100 AS lon,
       CASE WHEN n_nationkey = 7 THEN CAST(-500 AS DOUBLE) WHEN n_nationkey = 13 THEN CAST(9999 AS DOUBLE)
            ELSE CAST(100 * n_regionkey + 10 * n_nationkey AS DOUBLE) END AS elev
FROM nation
"""

SQL["fx_other_source"] = """
SELECT CAST(user_id % 10 AS INT) AS cell_id, CAST(ts AS DATE) AS obs_date,
       MAX(CASE WHEN event_type IN ('click', 'view') THEN value END) AS source1,
       MAX(CASE WHEN event_type IN ('view', 'purchase') THEN value END) AS source2
FROM events GROUP BY 1, 2
"""

SQL["fx_regions"] = """
SELECT * FROM (VALUES
  ('north', CAST(30.0 AS DOUBLE), CAST(30.5 AS DOUBLE), CAST(0.0 AS DOUBLE), CAST(0.25 AS DOUBLE)),
  ('south', CAST(30.0 AS DOUBLE), CAST(30.5 AS DOUBLE), CAST(-0.25 AS DOUBLE), CAST(0.0 AS DOUBLE)),
  ('centre', CAST(30.1 AS DOUBLE), CAST(30.4 AS DOUBLE), CAST(-0.15 AS DOUBLE), CAST(0.15 AS DOUBLE)),
  ('empty', CAST(50.0 AS DOUBLE), CAST(51.0 AS DOUBLE), CAST(10.0 AS DOUBLE), CAST(11.0 AS DOUBLE))
) AS r(region, lon_min, lon_max, lat_min, lat_max)
"""

SQL["fx_features"] = """
SELECT s_suppkey AS feature_seq,
       CASE WHEN s_suppkey % 3 = 0 THEN 'Point' WHEN s_suppkey % 3 = 1 THEN 'LineString' ELSE 'Polygon' END AS geom_type,
       CONCAT('{"type":"Feature","properties":{',
              CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE CONCAT('"ID":"P', CAST(s_suppkey AS STRING), '"') END,
              '},"geometry":{"type":"',
              CASE WHEN s_suppkey % 3 = 0 THEN CONCAT('Point","coordinates":[30.', CAST(s_suppkey % 10 AS STRING), ',0.1]')
                   WHEN s_suppkey % 3 = 1 THEN CONCAT('LineString","coordinates":[[30.', CAST(s_suppkey % 10 AS STRING), ',0.1],[30.2,0.2]]')
                   ELSE CONCAT('Polygon","coordinates":[[[30.', CAST(s_suppkey % 10 AS STRING), ',0.1],[30.3,0.1],[30.3,0.2],[30.', CAST(s_suppkey % 10 AS STRING), ',0.1]]]') END,
              '}}') AS feature_json
FROM supplier
"""

SQL["fx_sites"] = """
SELECT s_suppkey AS point_seq, s_name AS point_id,
       CASE WHEN s_suppkey % 97 = 0 THEN CAST(200 AS DOUBLE)
            ELSE CAST((s_suppkey * 37) % 600 - 300 AS DOUBLE) / 1000 END AS lat,
       CAST(30000 + (s_suppkey * 53) % 600 AS DOUBLE) / 1000 AS lon
FROM supplier
"""

def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view `name` over the tables of sf_dir."""
    sql = SQL[name]
    for table in TABLES:
        if re.search(rf"FROM {table}\b", sql):
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(f"gw_{table}")
            sql = re.sub(rf"FROM {table}\b", f"FROM gw_{table}", sql)
    return spark.sql(sql)


def with_views(names: tuple[str, ...]) -> str:
    """WITH clause that defines the views."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + " " if names else ""
