"""Views of the driver's tables in the shapes that the operators work on.

Each is one SQL text that Spark and DuckDB both run; tables stand in braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    # One row per position fix.
    "fixes": """SELECT concat('run_', l_returnflag) AS run_id, l_orderkey * 10e0 + l_linenumber AS t_s, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS ord,
        l_discount <= 6e-2 AS accepted, CAST(l_partkey % 997 AS DOUBLE) AS gt_east, CAST(l_suppkey % 89 AS DOUBLE) AS gt_north,
        (l_suppkey % 13) * 1e-1 - 6e-1 AS gt_yaw,
        CAST(l_partkey % 997 AS DOUBLE) + (l_quantity - 25e0) * 2e0 AS est_east, CAST(l_suppkey % 89 AS DOUBLE) + CAST(l_partkey % 61 AS DOUBLE) - 30e0 AS est_north,
        (l_suppkey % 13) * 1e-1 - 6e-1 + l_tax * 1e1 - 4e-1 AS est_yaw,
        1e0 + (l_partkey % 7) AS cov_ee, (l_suppkey % 5) * 1e-1 AS cov_en, 1e-2 AS cov_ey, 2e0 + (l_linenumber % 3) AS cov_nn, 2e-2 AS cov_ny, 1e-2 + l_tax AS cov_yy,
        l_extendedprice / 5e2 AS latency_ms, l_discount * 1e1 AS peak_ratio, l_tax * 1e1 AS covisibility, l_quantity AS n_inliers,
        l_quantity / 5e1 AS inlier_ratio, l_tax * 2e1 AS residual_rms_px, (l_partkey % 100) / 1e2 AS spatial_spread, 1e0 - l_discount AS mean_confidence,
        CASE l_suppkey % 8 WHEN 0 THEN 'urban' WHEN 1 THEN 'suburban' WHEN 2 THEN 'roads' WHEN 3 THEN 'farmland' WHEN 4 THEN 'forest' WHEN 5 THEN 'water' WHEN 6 THEN 'background' ELSE 'unlisted' END AS terrain
        FROM {lineitem}""",
    # One row per pose sample of a run, with the path so far.
    "track": """SELECT user_id AS run_id, event_id AS ord, value, event_type, event_type = 'purchase' AS accepted,
        CAST(event_id % 1009 AS DOUBLE) AS t_s, value * cos(event_id * 1e-1) AS v_east, value * sin(event_id * 1e-1) AS v_north,
        sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS path_m,
        CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS path_cm FROM {events}""",
    # Geographic points with deterministic coordinates.
    "points": """SELECT c_custkey AS id, 36e0 + (c_custkey % 600) * 1e-2 AS lon_deg, 40e0 + (c_custkey % 997) * 1e-2 AS lat_deg, c_acctbal AS alt,
        CAST(4 + c_custkey % 15 AS INT) AS z FROM {customer}""",
    # Scattered heights on a grid.
    "heights": """SELECT CAST(floor(l_extendedprice / 1e3) AS BIGINT) AS r, CAST(l_linenumber AS BIGINT) AS c, l_quantity AS z, l_tax * 1e1 AS confidence, l_discount * 1e3 AS range_m FROM {lineitem}""",
    # 8 x 8 images as a pixel table.
    "pixels": """SELECT vec_id AS image, CAST(floor(i / 8) AS BIGINT) AS r, CAST(i % 8 AS BIGINT) AS c, v FROM (SELECT vec_id, {index} AS i, {value} AS v FROM {embeddings})""",
    # A class raster: one cell per order.
    "classes": """SELECT CAST(floor(o_orderkey / 128) AS BIGINT) AS r, CAST(o_orderkey % 128 AS BIGINT) AS c, CAST(o_custkey % 6 AS INT) AS class FROM {orders}""",
    # Terrain: one cell of a metre per order.
    "terrain": """SELECT CAST(floor(o_orderkey / 128) AS BIGINT) AS r, CAST(o_orderkey % 128 AS BIGINT) AS c, (o_custkey % 40) * 1e-1 AS z, CASE WHEN o_orderkey % 3 = 0 THEN 1e0 ELSE 0e0 END AS lidar FROM {orders}""",
    # Camera frames above it: the 8 x 8 images, tilted forward by an angle of rational cosine (co) and sine (si).
    "frames": """SELECT vec_id AS image, 2013e-2 + vec_id * 37 % 80 AS cx, 537e-2 + vec_id * 21e-2 AS cy, 30e0 + vec_id % 7 AS cz,
        CASE vec_id % 3 WHEN 0 THEN 1e0 WHEN 1 THEN 96e-2 ELSE 8e-1 END AS co, CASE vec_id % 3 WHEN 0 THEN 0e0 WHEN 1 THEN 28e-2 ELSE 6e-1 END AS si FROM {embeddings}""",
    # Ways and their ordered node references; nodes are parts.
    "refs": """SELECT l_orderkey AS way, l_linenumber * 1000000 + l_partkey AS pos, l_partkey AS node FROM {lineitem}""",
    "nodes": """SELECT p_partkey AS node, CAST(p_partkey % 211 AS DOUBLE) AS east, CAST(p_size AS DOUBLE) AS north FROM {part} WHERE p_partkey % 9 <> 0""",
    # Aerial frames: pairs of a measured shift with its quality.
    "matches": """SELECT l_orderkey * 10 + l_linenumber AS id, l_discount > 1e-2 AS success, l_linenumber = 7 AS bad_scale, 1e0 + l_discount * 1e1 AS peak_ratio, l_tax * 1e1 AS valid_fraction,
        l_quantity - 25e0 AS shift_east_px, CAST(l_partkey % 31 AS DOUBLE) - 15e0 AS shift_north_px, l_tax - 4e-2 AS delta_yaw, 9e-1 + l_discount AS scale FROM {lineitem}""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over the tables of ``sf_dir``."""
    text = VIEWS[name]
    if name == "pixels":
        text = text.replace("SELECT vec_id, {index} AS i, {value} AS v FROM {embeddings}", "SELECT vec_id, posexplode(embedding) AS (i, v) FROM {embeddings}")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"{(\w+)}", text))}
    return spark.sql(text, **tables)


def sql(name: str) -> str:
    """The view as DuckDB SQL."""
    text = VIEWS[name].replace("{index}", "unnest(range(len(embedding)))").replace("{value}", "unnest(embedding)")
    return re.sub(r"{(\w+)}", r"\1", text)


def with_views(*names: str) -> str:
    """A WITH clause of the named views."""
    return "WITH " + ", ".join(f"{n} AS ({sql(n)})" for n in names) + " "
