"""Queries over package layers, names, series and fixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geodesy
from ..operators import align, generate
from ..sources import packages as p
from .map_queries import _tables
from .tools import add

_box = lambda: (F.col("lat_deg"), F.col("lat_deg") + 1, F.col("lon_deg"), F.col("lon_deg") + 1)
add("f61_f62_box_names", "points", lambda t: t.select("id", p.box_name("OT", "GLO30", *(F.round(c, 2) + 0.00003 for c in _box())).alias("name")), "SELECT id, printf('OT_GLO30_S%.4f_N%.4f_W%.4f_E%.4f_DEM.tif', round(lat_deg, 2) + 3e-5 - 1e-2, round(lat_deg + 1, 2) + 3e-5 + 1e-2, round(lon_deg, 2) + 3e-5 - 1e-2, round(lon_deg + 1, 2) + 3e-5 + 1e-2) AS name FROM points")
add("f63_tile_urls", "points", lambda t: t.select("id", p.tile_url("https://{s}.tiles/{z}/{x}/{y}.png", F.col("id") * 3, F.col("id") + 7, F.col("z"), ("a", "b", "c"), F.col("id")).alias("url")), "SELECT id, 'https://' || ['a', 'b', 'c'][id % 3 + 1] || '.tiles/' || z || '/' || id * 3 || '/' || (id + 7) || '.png' AS url FROM points")
add("p17_tile_sources", "points", lambda t: t.select("id", p.source_of_tile(F.concat(F.when(F.col("z") > 12, "Cop_10_").when(F.col("z") > 8, "Cop_30_").otherwise("else_"), F.col("id")), {"Cop_10_": "glo30", "Cop_30_": "glo90"}).alias("source")), "SELECT id, CASE WHEN z > 12 THEN 'glo30' WHEN z > 8 THEN 'glo90' ELSE 'unknown' END AS source FROM points")
add("f59_shown", "points", lambda t: t.select("id", p.shown(F.when(F.col("z") > 5, F.floor("alt").cast("double")), 1).alias("shown")), "SELECT id, CASE WHEN z > 5 THEN format('{:,.1f}', floor(alt) + 0e0) ELSE '—' END AS shown FROM points")


def _back(t: DataFrame) -> DataFrame:
    """A pixel to projected metres, degrees and back."""
    at = t.select("id", F.radians("lat_deg").alias("la"), F.radians("lon_deg").alias("lo")).withColumn("u", geodesy.utm(F.col("la"), F.col("lo"), 37))
    at = at.withColumn("g", geodesy.utm_inverse(F.col("u.easting"), F.col("u.northing"), 37)).withColumn("b", geodesy.utm(F.col("g.lat"), F.col("g.lon"), 37))
    return at.select("id", (p.cell_error(F.col("u.easting"), F.col("u.northing"), F.col("b.easting"), F.col("b.northing")) < 1e-3).alias("close"))


add("a40_cell_error", "points", _back, "SELECT id, abs(lon_deg - 39) <= 20 AS close FROM points")
add("p06_p07_velocity_frames", "track", lambda t: t.select("ord", *(v.alias(n) for n, v in zip(("ve", "vn"), align.velocity_en("ned", F.col("v_east"), F.col("v_north")), strict=True)), align.ratio_ok(F.col("value") / 30, 0.5).alias("ok")), "SELECT ord, v_north AS ve, v_east AS vn, abs(value / 30 - 1) <= 5e-1 AS ok FROM track", "ve, vn", "ord, ok")
add("a24_terrain_counts", "fixes", lambda f: generate.terrain_counts(f.withColumn("terrain", F.when(F.col("terrain") != "unlisted", F.col("terrain")))), "SELECT CASE WHEN terrain = 'unlisted' THEN 'background' ELSE terrain END AS terrain, count(*) AS n FROM fixes GROUP BY 1")
add("p19_pair_deltas", "fixes", lambda f: generate.pair_delta(f.withColumnsRenamed({"est_east": "prior_east", "est_north": "prior_north", "est_yaw": "prior_yaw"})).select("ord", "delta_east", "delta_north", "delta_yaw"), "SELECT ord, gt_east - est_east AS delta_east, gt_north - est_north AS delta_north, atan2(sin(gt_yaw - est_yaw), cos(gt_yaw - est_yaw)) AS delta_yaw FROM fixes", "delta_east, delta_north, delta_yaw", "ord")
add("n23_refined_fixes", "fixes", lambda f: p.refined_fix(f.select("ord", F.col("est_east").alias("dx"), F.col("est_north").alias("dy"), F.col("est_yaw").alias("yaw"), *(f"cov_{k}" for k in ("ee", "en", "ey", "nn", "ny", "yy"))), 0.5, 1.0, 0.2, 0.01).select("ord", "delta_east", "delta_north", "delta_yaw", "cov_ee", "cov_ey", "cov_yy"), "SELECT ord, est_east / 2 AS delta_east, est_north / 2 AS delta_north, atan2(sin(-est_yaw), cos(-est_yaw)) AS delta_yaw, greatest(cov_ee / 4 + 1, 4e-2) AS cov_ee, cov_ey / 2 AS cov_ey, greatest(cov_yy, 1e-4) AS cov_yy FROM fixes", "delta_east, delta_north, delta_yaw, cov_ee, cov_ey, cov_yy", "ord")
_fix = lambda t, k: t.select("ord", (F.col("v_east") * k).alias("delta_east"), (F.col("v_north") * k).alias("delta_north"), (F.col("value") * k).alias("delta_yaw"), (F.col("accepted") & (F.col("value") > 20)).alias("converged"))
add("n25_best_fixes", "track", lambda t: p.best_fix(_fix(t, 0.5), _fix(t, 0.25), ["ord"]), "SELECT ord, v_east * k AS delta_east, v_north * k AS delta_north, value * k AS delta_yaw, accepted AND value > 20 AS refined FROM (SELECT *, CASE WHEN accepted AND value > 20 THEN 25e-2 ELSE 5e-1 END AS k FROM track)", "delta_east, delta_north, delta_yaw", "ord, refined")


def _series(t: DataFrame) -> DataFrame:
    nodes = t.select("run_id", F.col("ord").cast("double").alias("t_s"), F.array(*(F.col("value") * k for k in range(9))).alias("rotation"), F.array(F.lit(0.0), F.col("path_m"), F.lit(1.0)).alias("translation"))
    back = p.series_from_json(p.series_to_json(nodes, scale=1.5))
    return back.select("run_id", F.col("t_s").cast("long").alias("ord"), F.col("rotation")[2].alias("r2"), F.col("translation")[1].alias("t1"), "scale", "mirror_z")


add("s33_s34_series", "track", _series, "SELECT run_id, ord, value * 2 AS r2, path_m AS t1, 15e-1 AS scale, false AS mirror_z FROM track", "r2, t1, scale", "run_id, ord, mirror_z", 4)
_tables("p09_nested_paths", "events", lambda e: e.select("event_id", p.nested("props", "k").cast("long").alias("k"), p.nested("props", "k.none").alias("none")), "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS none FROM events")
_tables("r02_k05_layer_tiles", "orders customer", lambda o, c: p.layer_tiles(o.select((F.col("o_custkey") % 64).alias("x"), F.floor(F.col("o_custkey") / 64).alias("y")), c.select((F.col("c_custkey") % 64).alias("x"), F.floor(F.col("c_custkey") / 64).alias("y"), F.when(F.col("c_custkey") % 13 == 0, "card").otherwise(F.col("c_name")).alias("digest"), F.when(F.col("c_custkey") % 13 == 0, 2.0).otherwise(50.0).alias("spread"))), "SELECT DISTINCT o_custkey % 64 AS x, CAST(floor(o_custkey / 64) AS BIGINT) AS y, CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM customer) THEN 'missing' WHEN o_custkey % 13 = 0 AND (SELECT count(*) FROM customer WHERE c_custkey % 13 = 0) >= 4 THEN 'placeholder' ELSE 'ok' END AS state FROM orders")
_tables("s38_s39_tombstones", "orders", lambda o: p.without_tombstones(o.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus") == "F").alias("missing")))[0].select("k", "s"), "SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderstatus <> 'F'")
_tables("s40_foreign_tiles", "orders", lambda o: p.foreign_tiles(o.select(F.concat(F.lit("/cache/z"), F.col("o_orderkey") % 20 + 1, F.lit("/"), F.col("o_custkey"), F.lit("/"), F.col("o_orderkey"), F.when(F.col("o_orderkey") % 3 == 0, ".txt").otherwise(".PNG")).alias("path")), "sasplanet", (5, 15)).select("z", "x", "y"), "SELECT DISTINCT CAST(o_orderkey % 20 AS INT) AS z, o_custkey AS x, o_orderkey AS y FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 20 BETWEEN 5 AND 15")
_tables("j16_geotransforms", "part", lambda t: p.geotransform_problems(t.select(F.col("p_partkey").alias("layer"), F.lit(100.0).alias("origin_east"), F.col("p_size").cast("double").alias("origin_north"), F.lit(0.5).alias("gsd")), t.filter("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("layer"), F.when(F.col("p_partkey") % 7 == 0, 101.0).otherwise(100.0).alias("origin_east"), F.col("p_size").cast("double").alias("origin_north"), F.lit(0.5).alias("gsd"), F.lit(0.5).alias("gsd_row"))).groupBy("field").agg(F.count("*").alias("n")), "SELECT field, count(*) AS n FROM part, unnest(['origin_east', 'origin_north', 'gsd', 'gsd_row']) AS t(field) WHERE p_partkey % 5 = 0 OR (p_partkey % 7 = 0 AND field = 'origin_east') GROUP BY field")


def _manifests(t: DataFrame) -> DataFrame:
    """A manifest per point, one layer each, of which fields are left out by the point's number."""
    has = lambda n, k: F.when(F.col("id") % n != 0, k)
    classes = F.array(*map(F.lit, p.CLASS_NAMES[:-1]), F.when(F.col("id") % 5 == 0, "wood").otherwise(p.CLASS_NAMES[-1]))
    body = F.struct(has(3, F.lit("s")).alias("source"), F.lit("2026").alias("extract_date"), has(7, F.lit("p")).alias("provider"), has(2, F.lit("d")).alias("source_datum"), F.lit("v").alias("vertical_datum"), F.lit("g").alias("geoid_model"), classes.alias("classes"))
    name = F.element_at(F.array(*map(F.lit, ("ortho_a", "dem", "semantic", "radar"))), (F.col("id") % 4 + 1).cast("int"))
    whole = F.struct(has(11, F.lit("EPSG:32637")).alias("crs"), F.lit(1).alias("origin"), F.create_map(name, body).alias("layers"))
    return t.select(F.col("id").alias("package"), F.to_json(whole).alias("value"))


add("p20_manifest_problems", "points", lambda t: p.manifest_problems(_manifests(t)), """SELECT id AS package, CAST(NULL AS VARCHAR) AS layer, 'crs' AS field, 'missing' AS problem FROM points WHERE id % 11 = 0
 UNION ALL SELECT id, 'ortho_a', 'provider', 'missing' FROM points WHERE id % 4 = 0 AND id % 7 = 0 UNION ALL SELECT id, 'dem', 'source', 'missing' FROM points WHERE id % 4 = 1 AND id % 3 = 0
 UNION ALL SELECT id, 'dem', 'source_datum', 'missing' FROM points WHERE id % 4 = 1 AND id % 2 = 0 UNION ALL SELECT id, 'semantic', 'source', 'missing' FROM points WHERE id % 4 = 2 AND id % 3 = 0
 UNION ALL SELECT id, 'semantic', 'classes', 'other value' FROM points WHERE id % 4 = 2 AND id % 5 = 0 UNION ALL SELECT id, 'radar', CAST(NULL AS VARCHAR), 'unknown layer' FROM points WHERE id % 4 = 3""")
