"""Input views over the test tables; the same text runs on Spark and on DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowguard.sources.tables import read_parquet

CMD = """
WITH base AS (
  SELECT o.o_orderkey AS id, o.o_custkey AS k, p.p_name AS true_city
  FROM {orders} o JOIN {part} p ON p.p_partkey = o.o_custkey
), clean AS (
  SELECT id, k, true_city,
         CAST(35 + (k % 7) * 3 AS DOUBLE) + CAST((id * 7919) % 1000 AS DOUBLE) / 1e4 AS lat0,
         CAST((k % 11) * 4 - 10 AS DOUBLE) + CAST((id * 104729) % 1000 AS DOUBLE) / 1e4 AS long0,
         (id % 97 = 11) AS swapped_geo,
         (id % 89 = 13) AS shuffle_lat,
         (id % 83 = 19) AS shuffle_long,
         (id % 211 = 17) AS missing_geo,
         (id % 17 = 3 OR id % 23 = 5 OR id % 101 = 7) AS typo_city
  FROM base
)
SELECT id AS id__cmd,
       CASE WHEN id % 17 = 3 THEN concat(substr(true_city, 1, 1), substr(true_city, 3))
            WHEN id % 23 = 5 THEN concat(true_city, substr(true_city, length(true_city), 1))
            WHEN id % 101 = 7 THEN concat(true_city, '?')
            ELSE true_city END AS city__cmd,
       CASE WHEN missing_geo THEN NULL WHEN swapped_geo THEN long0
            WHEN shuffle_lat THEN lat0 + 9e0 ELSE lat0 END AS lat__cmd,
       CASE WHEN missing_geo THEN NULL WHEN swapped_geo THEN lat0
            WHEN shuffle_long THEN long0 - 13e0 ELSE long0 END AS long__cmd,
       CAST(10000 + k AS VARCHAR(8)) AS post_code__cmd,
       true_city, swapped_geo, shuffle_lat, shuffle_long, missing_geo, typo_city
FROM clean
"""

SCORED = """
SELECT id__cmd, city__cmd, true_city, lat__cmd, long__cmd,
       (swapped_geo OR shuffle_lat OR shuffle_long) AS is_error,
       -(40e-2 + CAST((id__cmd * 31) % 1000 AS DOUBLE) / 1e4 + CASE WHEN swapped_geo OR shuffle_lat OR shuffle_long THEN 12e-2 ELSE 0e0 END) AS S_Score_coordinates,
       -(40e-2 + CAST((id__cmd * 37) % 1000 AS DOUBLE) / 1e4 + CASE WHEN swapped_geo OR shuffle_lat OR shuffle_long THEN 12e-2 ELSE 0e0 END) AS S_Score_city,
       -(40e-2 + CAST((id__cmd * 41) % 1000 AS DOUBLE) / 1e4 + CASE WHEN swapped_geo OR shuffle_lat OR shuffle_long THEN 12e-2 ELSE 0e0 END) AS S_Score_city_cluster,
       CASE WHEN id__cmd % 29 = 0 THEN NULL ELSE id__cmd % 13 END AS neighbors_count,
       CASE WHEN id__cmd % 29 = 0 THEN TRUE ELSE id__cmd % 13 <= 4 END AS is_isolated,
       CASE WHEN id__cmd % 3 = 0 THEN CAST((swapped_geo OR shuffle_lat OR shuffle_long) AS INT) END AS is_anomaly,
       true_city AS standardized_city,
       CASE WHEN lat__cmd IS NULL THEN 99 ELSE CAST(floor((lat__cmd + 90e0) / 6e0) AS INT) END AS cluster
FROM {cmd}
"""


def cmd(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_parquet(spark, folder, "orders", ["o_orderkey", "o_custkey"])
    part = read_parquet(spark, folder, "part", ["p_partkey", "p_name"])
    return spark.sql(CMD, orders=orders, part=part)


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(SCORED, cmd=cmd(spark, folder))


CMD_SQL = f"({CMD.format(orders='orders', part='part')})"
SCORED_SQL = f"({SCORED.format(cmd=CMD_SQL + ' cmd')})"


def with_cmd(select: str, ctes: str = "") -> str:
    """A DuckDB query that may name ``cmd`` and ``scored``, and further common table expressions."""
    extra = f", {ctes}" if ctes else ""
    return f"WITH RECURSIVE cmd AS {CMD_SQL}, scored AS ({SCORED.format(cmd='cmd')}){extra} {select}"
