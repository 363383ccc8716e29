"""Queries of the generators, one row or patch per row of a driver's table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import generate as g
from .tools import add

_ids = lambda p: p.select("id")
add("g01_pair_specs", "points", lambda p: g.pair_specs(_ids(p), "regression"), None)
_grid = lambda p: g.patch_grid(p.withColumns({"gt_east": F.col("lon_deg") * 100, "gt_north": F.col("alt"), "gt_yaw": F.radians("lat_deg")}), 4, 0.5).select("id", "r", "c", "east", "north")
add("g02_g16_patch_grid", "points", _grid, "SELECT id, CAST(r AS INT) AS r, CAST(c AS INT) AS c, lon_deg * 100 + cos(radians(lat_deg)) * (c - 15e-1) * 5e-1 - sin(radians(lat_deg)) * (15e-1 - r) * 5e-1 AS east, alt + sin(radians(lat_deg)) * (c - 15e-1) * 5e-1 + cos(radians(lat_deg)) * (15e-1 - r) * 5e-1 AS north FROM points, unnest(range(4)) AS a(r), unnest(range(4)) AS b(c)", "east, north", "id, r, c", 5)
add("g02_rendered_patches", "points", lambda p: g.render(g.patch_grid(g.pair_specs(_ids(p)), 8, 0.5), "forest").groupBy("id").agg(F.avg("rgb.g").alias("mean"), F.stddev_pop("rgb.g").alias("spread")), None)
add("g05_augmented", "points", lambda p: g.augment(p.select("id", F.lit(0).alias("r"), F.lit(0).alias("c"), F.pmod(F.abs("alt"), F.lit(255.0)).alias("v")), {"gamma": 1.2, "haze": 0.1, "contrast": 1.1}).select("id", "v"), "SELECT id, least(255, greatest(0, least(255, greatest(0, (least(255, greatest(0, pow((abs(alt) - 255 * floor(abs(alt) / 255)) / 255, 1 / 12e-1) * 255)) - 128) * 11e-1 + 128)) * 9e-1 + 18e0)) AS v FROM points", "v", "id", 5)
add("g09_region", "points", lambda p: g.region(p.select(F.col("lon_deg").alias("east"), F.col("lat_deg").alias("north")), 0.5), "SELECT min(lon_deg) + 5e-1 AS east_min, max(lon_deg) - 5e-1 AS east_max, min(lat_deg) + 5e-1 AS north_min, max(lat_deg) - 5e-1 AS north_max FROM points", "east_min, east_max, north_min, north_max")
add("g11_point_clouds", "points", lambda p: g.cloud(p.select("id", F.col("lon_deg").alias("east"), F.col("lat_deg").alias("north"), F.lit(60.0).alias("up")), 20).groupBy("id").agg(F.count("*").alias("n"), F.avg("up").alias("up")), None)
add("n09_ray_march", "points", lambda p: p.select("id", g.march((F.col("lon_deg"), F.col("lat_deg"), F.lit(100.0)), (F.lit(0.3), F.lit(0.1), F.lit(-1.0)), lambda x, y: F.col("alt") / 500 + 0 * x, 160.0).alias("s"), "alt").select("id", (F.abs(F.col("s") - (100 - F.col("alt") / 500)) < 0.02).alias("close")), "SELECT id, true AS close FROM points")
add("n24_grid_descriptors", "pixels", lambda p: g.grid_descriptors(p).select("image", "x", "y", F.aggregate("descriptor", F.lit(0), lambda a, d: a + d.cast("int")).alias("balance")), "SELECT q.image, 4e0 AS x, 4e0 AS y, CAST(sum(CASE WHEN v > m THEN 1 ELSE -1 END) AS INT) AS balance FROM pixels p JOIN (SELECT image, avg(CAST(v AS DOUBLE)) AS m FROM pixels GROUP BY image) q ON p.image = q.image GROUP BY q.image")
