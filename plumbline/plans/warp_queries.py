"""Queries over camera frames and terrain: warped patches, their mosaic and the frames that make it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import warp
from .tools import add

CAMERA = warp.Camera(8.0, 8.0, 4.0, 4.0, 8, 8)
SIZE, GSD, STEPS, PARTS, ROUNDS, HIGHEST, EVERY = 6, 2.7, 48, 64, 3, 34.0, 2


def _frames(f: DataFrame) -> DataFrame:
    return f.select("image", "cx", "cy", "cz", F.expr("array(1e0, 0e0, 0e0, 0e0, -co, si, 0e0, -si, -co)").alias("rot"))


def _patches(f: DataFrame, t: DataFrame, p: DataFrame) -> DataFrame:
    made = warp.warp(_frames(f), p.withColumn("v", F.col("v").cast("double")), t, 1.0, CAMERA, SIZE, GSD)
    return made.select("image", "r", "c", "east", "north", "v", "confidence")


def _mosaic(f: DataFrame, t: DataFrame, p: DataFrame) -> tuple[DataFrame, DataFrame]:
    return warp.mosaic(_frames(f), p.withColumn("v", F.col("v").cast("double")), t, 1.0, CAMERA, SIZE, GSD, agl_max=HIGHEST, every=EVERY)


def _patches_sql(kept: str) -> str:
    """Every step of every ray, joined with the terrain's cells one by one."""
    at = "{a}.r = floor({y} / 1e0) AND {a}.c = floor({x} / 1e0)"
    meets = lambda a, x, y: at.format(a=a, x=x, y=y)
    sql = f"""WITH g AS (SELECT f.*, t.z AS tz, coalesce(greatest(cz - t.z, 30e0), 100e0) AS agl FROM frames f LEFT JOIN terrain t ON {meets("t", "cx", "cy")} WHERE {kept}),
 i AS (SELECT g.*, pr, pc, cx + (pc - 3e0 + 5e-1) * 27e-1 AS x, cy - (pr - 3e0 + 5e-1) * 27e-1 AS y FROM g, unnest(range({SIZE})) AS a(pr), unnest(range({SIZE})) AS b(pc)),
 s0 AS (SELECT i.*, coalesce(t.z, cz - agl) AS z FROM i LEFT JOIN terrain t ON {meets("t", "x", "y")})"""
    for n in range(ROUNDS):
        sql += f""",
 d{n} AS (SELECT image, cx, cy, cz, co, si, agl, pr, pc, (x - cx) / l AS dx, (y - cy) / l AS dy, (z - cz) / l AS dz, 15e-2 * agl AS near, 16e-1 * agl AS far
   FROM (SELECT *, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz)) AS l FROM s{n}) q),
 k{n} AS (SELECT image, pr, pc, min(k) AS k FROM (SELECT image, pr, pc, k, cx + s * dx AS x, cy + s * dy AS y, cz + s * dz AS z FROM (SELECT *, near + k * (far - near) / {STEPS} AS s FROM d{n}, unnest(range(1, {STEPS + 1})) AS a(k)) q) q
   JOIN terrain t ON {meets("t", "q.x", "q.y")} WHERE q.z <= t.z GROUP BY 1, 2, 3),
 b{n} AS (SELECT d.*, k, near + (k - 1) * ((far - near) / {STEPS}) AS lo, near + (k - 1) * ((far - near) / {STEPS}) + (far - near) / {STEPS} AS hi FROM d{n} d LEFT JOIN k{n} USING (image, pr, pc)),
 l{n} AS (SELECT image, pr, pc, min(j) AS j FROM (SELECT image, pr, pc, j, cx + s * dx AS x, cy + s * dy AS y, cz + s * dz AS z FROM (SELECT *, lo + j * (hi - lo) / {PARTS} AS s FROM b{n}, unnest(range(1, {PARTS + 1})) AS a(j) WHERE k IS NOT NULL) q) q
   JOIN terrain t ON {meets("t", "q.x", "q.y")} WHERE q.z <= t.z GROUP BY 1, 2, 3),
 m{n} AS (SELECT image, cx, cy, cz, co, si, agl, pr, pc, k IS NOT NULL AS hit, cx + s * dx AS x, cy + s * dy AS y, cz + s * dz AS z FROM
   (SELECT b.*, CASE WHEN k IS NULL THEN far ELSE lo + (coalesce(j, {PARTS}) - 5e-1) * ((far - near) / {STEPS}) / {PARTS} END AS s FROM b{n} b LEFT JOIN l{n} USING (image, pr, pc)) q),
 s{n + 1} AS (SELECT m.* EXCLUDE (z), coalesce(t.z, m.z) AS z, coalesce(t.lidar, 0e0) AS lidar, t.z IS NOT NULL AS ground FROM m{n} m LEFT JOIN terrain t ON {meets("t", "m.x", "m.y")})"""
    return sql + f""",
 e AS (SELECT *, si * (y - cy) + (-co) * (z - cz) AS depth, x - cx AS across, (-co) * (y - cy) + (-si) * (z - cz) AS down FROM s{ROUNDS}),
 h AS (SELECT *, CASE WHEN depth > 0 THEN 8 * (across / depth) + 4 END AS u, CASE WHEN depth > 0 THEN 8 * (down / depth) + 4 END AS w FROM e),
 o AS (SELECT h.image, h.pr, h.pc, CASE WHEN count(*) FILTER (WHERE weight > 0 AND p.v IS NULL) = 0 THEN sum(weight * CAST(p.v AS DOUBLE)) FILTER (WHERE weight > 0) END AS v
   FROM (SELECT *, (CASE WHEN dc = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) * (CASE WHEN dr = 1 THEN w - floor(w) ELSE 1 - (w - floor(w)) END) AS weight FROM h, unnest([0, 1]) AS a(dr), unnest([0, 1]) AS b(dc)) h
   LEFT JOIN pixels p ON p.image = h.image AND p.r = floor(w) + dr AND p.c = floor(u) + dc GROUP BY 1, 2, 3),
 w AS (SELECT h.image, h.pr AS r, h.pc AS c, x AS east, y AS north, coalesce(o.v, 0e0) AS v, agl, lidar,
   coalesce(hit AND ground AND u >= 0 AND u < 8 AND w >= 0 AND w < 8, false) AS usable FROM h LEFT JOIN o ON o.image = h.image AND o.pr = h.pr AND o.pc = h.pc),
 x AS (SELECT *, CASE WHEN usable THEN 255e0 * lidar + 64e0 * (1 - lidar) ELSE 0e0 END AS confidence FROM w)"""


add("n06_warped_patches", "frames terrain pixels", _patches, _patches_sql("true") + " SELECT image, r, c, east, north, v, confidence FROM x", "east, north, v, confidence", "image, r, c", 5)
LOW = f"f.image % {EVERY} = 0 AND cz - t.z <= 34e0"
add("n07_mosaic", "frames terrain pixels", lambda f, t, p: _mosaic(f, t, p)[0], _patches_sql(LOW) + " SELECT CAST(floor(-north / 27e-1) AS BIGINT) AS r, CAST(floor(east / 27e-1) AS BIGINT) AS c, sum(v * confidence * confidence) / sum(confidence * confidence) AS v, sum(confidence * confidence) AS weight FROM x WHERE confidence > 0 GROUP BY 1, 2", "v, weight", "r, c", 5)
STATS = f""" SELECT image, agl, lidar_share, skipped FROM (SELECT image, min(agl) AS agl, coalesce(avg(CASE WHEN usable THEN lidar END), 0e0) AS lidar_share, false AS skipped FROM x GROUP BY image
 UNION ALL SELECT f.image, cz - t.z, 0e0, true FROM frames f LEFT JOIN terrain t ON t.r = floor(cy) AND t.c = floor(cx) WHERE f.image % {EVERY} = 0 AND coalesce(cz - t.z > 34e0, true)) q"""
add("n07_mosaic_frames", "frames terrain pixels", lambda f, t, p: _mosaic(f, t, p)[1], _patches_sql(LOW) + STATS, "agl, lidar_share", "image, skipped", 6)
