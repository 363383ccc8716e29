"""Queries over map windows and pyramid levels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import windows as w
from .tools import add

LEVELS = "lv AS (SELECT CAST(k AS BIGINT) AS level, CAST(pow(2, k) AS DOUBLE) AS gsd, 500e0 AS oe, 9000e0 AS o_n, CAST(ceil(5000 / pow(2, k)) AS BIGINT) AS width, CAST(ceil(8000 / pow(2, k)) AS BIGINT) AS height FROM (SELECT DISTINCT z % 4 AS k FROM points))"
ASKED = "rq AS (SELECT id, (lon_deg - 36) * 1000 AS e, (lat_deg - 40) * 1000 AS n, 50e0 + z * 10 AS r, abs(alt) / 1000 AS g FROM points)"


def _levels(p: DataFrame) -> DataFrame:
    """Four levels, halving from one metre, of a raster of 5 by 8 kilometres."""
    k = F.pmod(F.col("z"), F.lit(4))
    size = lambda n: F.ceil(n / F.pow(F.lit(2.0), F.col("k"))).cast("long")
    return p.select(k.alias("k")).distinct().select(F.col("k").cast("long").alias("level"), F.pow(F.lit(2.0), F.col("k")).alias("gsd"), F.lit(500.0).alias("origin_east"), F.lit(9000.0).alias("origin_north"), size(5000).alias("width"), size(8000).alias("height"))


def _asked(p: DataFrame) -> DataFrame:
    return p.select("id", ((F.col("lon_deg") - 36) * 1000).alias("east"), ((F.col("lat_deg") - 40) * 1000).alias("north"), (50.0 + F.col("z") * 10).alias("radius_m"), (F.abs("alt") / 1000).alias("gsd"))


SERVED = f"""{LEVELS}, {ASKED}, bl AS (SELECT * FROM lv WHERE gsd = (SELECT min(gsd) FROM lv)),
 pk AS (SELECT rq.*, coalesce((SELECT max(gsd) FROM lv WHERE lv.gsd <= rq.g), (SELECT gsd FROM bl)) AS lg FROM rq),
 lw AS (SELECT pk.*, lv.level, lv.width, lv.height, e - 500 AS de, 9000 - n AS dn, (e - 500) / (SELECT gsd FROM bl) BETWEEN 0 AND (SELECT width FROM bl) AND (9000 - n) / (SELECT gsd FROM bl) BETWEEN 0 AND (SELECT height FROM bl) AS ok FROM pk JOIN lv ON lv.gsd = pk.lg),
 xy AS (SELECT *, CAST(greatest(0, least(floor(de / lg - r / lg), width)) AS BIGINT) AS x0, CAST(greatest(0, least(floor(dn / lg - r / lg), height)) AS BIGINT) AS y0, CAST(greatest(0, least(floor(de / lg - r / lg) + ceil(2 * (r / lg)), width)) AS BIGINT) AS x1, CAST(greatest(0, least(floor(dn / lg - r / lg) + ceil(2 * (r / lg)), height)) AS BIGINT) AS y1 FROM lw),
 sv AS (SELECT id, ok AND x1 > x0 AND y1 > y0 AS success, CASE WHEN NOT ok THEN 'request centre outside mission package' WHEN x1 <= x0 OR y1 <= y0 THEN 'window outside mission package' END AS message, level, lg AS level_gsd, x0, y0, x1 - x0 AS w, y1 - y0 AS h FROM xy)"""
add("j19_served_windows", "points", lambda p: w.serve(_asked(p), _levels(p)), f"WITH {SERVED} SELECT id, success, message, level, level_gsd, CASE WHEN success THEN x0 END AS x0, CASE WHEN success THEN y0 END AS y0, CASE WHEN success THEN w END AS w, CASE WHEN success THEN h END AS h, CASE WHEN success THEN 500 + x0 * level_gsd END AS corner_east, CASE WHEN success THEN 9000 - y0 * level_gsd END AS corner_north FROM sv", "level_gsd, corner_east, corner_north", "id, success, message, level, x0, y0, w, h")
add("t04_prefetch_tiles", "points", lambda p: w.tiles_of(w.serve(_asked(p), _levels(p)), 64), f"WITH {SERVED} SELECT id, level, a AS ty, b AS tx FROM sv, unnest(range(y0 // 64, (y0 + h - 1) // 64 + 1)) AS u(a), unnest(range(x0 // 64, (x0 + w - 1) // 64 + 1)) AS v(b) WHERE success")
_small = lambda p: p.select("id", F.lit(True).alias("success"), F.lit(0).cast("long").alias("level"), F.pmod(F.col("id"), F.lit(100)).alias("x0"), F.pmod(F.floor(F.col("id") / 3), F.lit(20)).alias("y0"), F.lit(9).alias("w"), F.lit(7).alias("h"))
_cells = lambda c: c.select(F.lit(0).cast("long").alias("level"), "r", "c", F.col("class").alias("v"))
add("r22_window_pixels", "points classes", lambda p, c: w.read(_small(p), _cells(c), _cells(c).filter("v < 3").withColumn("v", F.lit(0)), 16), "SELECT p.id, k.r - (p.id // 3) % 20 AS r, k.c - p.id % 100 AS c, k.class AS v, CAST(CASE WHEN k.class < 3 THEN 0 ELSE 255 END AS INT) AS valid FROM points p JOIN classes k ON k.r >= (p.id // 3) % 20 AND k.r < (p.id // 3) % 20 + 7 AND k.c >= p.id % 100 AND k.c < p.id % 100 + 9")
add("p24_inside_raster", "points", lambda p: p.select("id", w.inside(F.col("lon_deg") * 100 - 3700, F.col("alt"), F.lit(300), F.lit(5000)).alias("inside")), "SELECT id, lon_deg * 100 - 3700 >= 0 AND lon_deg * 100 - 3700 <= 300 AND alt >= 0 AND alt <= 5000 AS inside FROM points")
add("r05_pyramid_levels", "points", lambda p: w.levels_of(p.groupBy("z").agg(F.count("*").alias("width"), F.sum(F.lit(3)).alias("height")).select(F.lit(0.5).alias("gsd"), F.col("z").cast("double").alias("origin_east"), F.lit(0.0).alias("origin_north"), "width", "height")), "WITH b AS (SELECT z, count(*) AS w, 3 * count(*) AS h FROM points GROUP BY z) SELECT CAST(k AS INT) AS level, pow(2, k) / 2 AS gsd, CAST(z AS DOUBLE) AS origin_east, 0e0 AS origin_north, CAST(ceil(w / pow(2, k)) AS BIGINT) AS width, CAST(ceil(h / pow(2, k)) AS BIGINT) AS height FROM b, unnest([0, 1, 2, 3]) AS t(k)", "gsd, origin_east, origin_north", "level, width, height")
ORIGIN = (math.radians(45.0), math.radians(39.0), 120.0)
_enu = lambda p: p.select("id", ((F.col("lon_deg") - 39) * 1000).alias("east"), ((F.col("lat_deg") - 45) * 1000).alias("north"))
add("r21_projected_round_trip", "points", lambda p: w.to_local(w.to_projected(_enu(p), ORIGIN, 37).select("id", F.round("easting", 3).alias("easting"), F.round("northing", 3).alias("northing")), ORIGIN, 37).select("id", "east", "north"), "SELECT id, (lon_deg - 39) * 1000 AS east, (lat_deg - 45) * 1000 AS north FROM points", "east, north", "id", 1)
_box = lambda p: p.select("id", F.col("lon_deg").alias("west"), F.col("lat_deg").alias("south"), (F.col("lon_deg") + 0.2).alias("east"), (F.col("lat_deg") + 0.1).alias("north"))
_x, _y = "CAST(floor(({0} + 180) / 360 * 1024) AS BIGINT)", "CAST(floor((1 - asinh(tan(radians({0}))) / pi()) / 2 * 1024) AS BIGINT)"
add("r01_box_cover", "points", lambda p: w.tile_cover(_box(p), 10).select("id", "x", "y"), f"SELECT id, x, y FROM points, unnest(range({_x.format('lon_deg')}, {_x.format('(lon_deg + 2e-1)')} + 1)) AS a(x), unnest(range({_y.format('(lat_deg + 1e-1)')}, {_y.format('lat_deg')} + 1)) AS b(y)")
_shot = lambda t, d: t.select(F.col("ord").alias("id"), (F.col("ord") % 1000 + d).alias("t_s"))
add("j18_answers_in_time", "track", lambda t: w.requests_for(_shot(t, F.lit(0)), _shot(t, F.floor("value") - 10), 20).select("id", "answered", "late"), "WITH q AS (SELECT ord, ord % 1000 AS t, CAST(floor(value) AS BIGINT) - 10 AS d FROM track) SELECT ord AS id, CASE WHEN d BETWEEN 0 AND 20 THEN t + d END AS answered, NOT (d BETWEEN 0 AND 20) AS late FROM q")
_held = lambda t: t.withColumn("held", F.lag(F.struct(F.col("path_m").alias("east"), F.col("value").alias("north"), F.col("t_s").alias("gsd"), F.col("event_type").alias("model"))).over(_by()))


def _by():
    from pyspark.sql import Window

    return Window.partitionBy("run_id").orderBy("ord")


add("p25_descriptors_valid", "track", lambda t: _held(t.withColumn("t_s", F.floor(F.col("t_s") / 500))).select("ord", w.descriptors_valid(F.col("path_m"), F.col("value"), F.lit(150.0), F.col("t_s"), F.col("event_type"), F.col("held")).alias("valid")), "SELECT ord, coalesce(sqrt(pow(path_m - lag(path_m) OVER w, 2) + pow(value - lag(value) OVER w, 2)) <= 90 AND floor(t_s / 500) = lag(floor(t_s / 500)) OVER w AND event_type = lag(event_type) OVER w, false) AS valid FROM track WINDOW w AS (PARTITION BY run_id ORDER BY ord)")
