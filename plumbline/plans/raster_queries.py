"""Queries over pixel tables, masks, ways, tiles and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grids as g
from ..operators import metrics as m
from ..operators import semantic
from ..operators.quantiles import exact_quantiles
from . import register
from .tools import add, rounded

add("a29_grid_accumulate", "heights", lambda h: g.accumulate(h).select("r", "c", "z_max", "n", "z2", "z_mean", "spread", "spread_about_max"), "SELECT r, c, max(z) AS z_max, count(*) AS n, sum(z * z) AS z2, avg(z) AS z_mean, stddev_pop(z) AS spread, sqrt(greatest(0, sum(z * z) / count(*) - max(z) * max(z))) AS spread_about_max FROM heights GROUP BY r, c", "z_max, z2, z_mean, spread, spread_about_max", "r, c, n", 4)
CELLS = "c0 AS (SELECT r, c, max(z) AS z_max, count(*) AS n, sqrt(greatest(0, sum(z * z) / count(*) - max(z) * max(z))) AS s FROM heights GROUP BY r, c)"
add("w09_focal_median", "heights", lambda h: g.focal_median(g.accumulate(h)).select("r", "c", "z", "confidence"), f"WITH {CELLS}, md AS (SELECT a.r, a.c, median(b.z_max) AS md FROM c0 a JOIN c0 b ON b.r BETWEEN a.r - 2 AND a.r + 2 AND b.c BETWEEN a.c - 2 AND a.c + 2 GROUP BY a.r, a.c) SELECT c0.r, c0.c, CASE WHEN abs(z_max - md) > 3 THEN md ELSE z_max END AS z, CAST(CASE WHEN abs(z_max - md) > 3 THEN 96 WHEN n >= 4 AND s > 2 THEN 192 WHEN n >= 4 THEN 255 ELSE 128 END AS INT) AS confidence FROM c0 JOIN md ON c0.r = md.r AND c0.c = md.c", "z", "r, c, confidence")
add("a20_class_fractions", "classes", lambda c: c.groupBy(F.floor(F.col("r") / 32).alias("block")).agg(*(F.avg((F.col("class") == i).cast("double")).alias(f"f{i}") for i in range(6))), "SELECT CAST(floor(r / 32) AS BIGINT) AS block, " + ", ".join(f"avg(CASE WHEN class = {i} THEN 1e0 ELSE 0e0 END) AS f{i}" for i in range(6)) + " FROM classes GROUP BY 1", "f0, f1, f2, f3, f4, f5", "block")


def _terrain(c: DataFrame) -> DataFrame:
    pts = c.select((F.col("r") * 128 + F.col("c")).alias("id"), "r", "c")
    f = g.window_fractions(pts, c, 5)
    return f.select("id", m.terrain_of({"road": F.col("f1"), "building": F.col("f2") / 3, "water": F.col("f3"), "farmland": F.col("f4"), "forest": F.col("f5")}).alias("terrain"), "n", "f3")


add("j05_terrain_of_windows", "classes", _terrain, "WITH p AS (SELECT r * 128 + c AS id, r, c FROM classes), f AS (SELECT p.id, count(*) AS n, " + ", ".join(f"avg(CASE WHEN class = {i} THEN 1e0 ELSE 0e0 END) AS f{i}" for i in range(6)) + " FROM p JOIN classes k ON abs(k.r - p.r) <= 5 AND abs(k.c - p.c) <= 5 GROUP BY p.id) SELECT id, CASE WHEN f3 > 5e-1 THEN 'water' WHEN f2 / 3 > 15e-2 THEN 'urban' WHEN f4 > 6e-1 THEN 'farmland' WHEN f5 > 6e-1 THEN 'forest' WHEN f1 > 5e-2 AND f2 / 3 < 3e-2 THEN 'roads' WHEN f2 / 3 >= 3e-2 THEN 'suburban' ELSE 'background' END AS terrain, n, f3 FROM f", "f3", "id, terrain, n")
WIN = "OVER (PARTITION BY image, r ORDER BY c)", "OVER (PARTITION BY image, c ORDER BY r)"
add("w14_central_gradient", "pixels", lambda p: g.gradient(p.withColumn("v", F.col("v").cast("double"))).select("image", "r", "c", "gx", "gy"), f"SELECT image, r, c, (coalesce(lead(v) {WIN[0]}, v) - coalesce(lag(v) {WIN[0]}, v)) / 2e0 AS gx, (coalesce(lead(v) {WIN[1]}, v) - coalesce(lag(v) {WIN[1]}, v)) / 2e0 AS gy FROM (SELECT image, r, c, CAST(v AS DOUBLE) AS v FROM pixels)", "gx, gy", "image, r, c", 5)
NB = "(SELECT a.image, a.r, a.c, dr, dc, b.v FROM pixels a, unnest([-1, 0, 1]) AS x(dr), unnest([-1, 0, 1]) AS y(dc), pixels b WHERE b.image = a.image AND b.r = greatest(0, least(7, a.r + dr)) AND b.c = greatest(0, least(7, a.c + dc)))"
add("w15_sobel", "pixels", lambda p: g.sobel(p.withColumn("v", F.col("v").cast("double"))).select("image", "r", "c", "gx", "gy"), f"SELECT image, r, c, sum(CAST(v AS DOUBLE) * dc * (2 - abs(dr))) AS gx, sum(CAST(v AS DOUBLE) * dr * (2 - abs(dc))) AS gy FROM {NB} GROUP BY image, r, c", "gx, gy", "image, r, c", 5)
add("w10_box_blur", "pixels", lambda p: g.box_blur(p.withColumn("v", F.col("v").cast("double"))).select("image", "r", "c", "v"), f"SELECT image, r, c, sum(CAST(v AS DOUBLE)) / 9 AS v FROM {NB} GROUP BY image, r, c", "v", "image, r, c", 5)
add("w12_dilation", "pixels", lambda p: g.dilate(p.filter("v > 0.3").select("image", "r", "c"), 2).groupBy("image").agg(F.count("*").alias("n")), "SELECT image, count(*) AS n FROM (SELECT DISTINCT image, r + dr, c + dc FROM pixels, unnest([-2, -1, 0, 1, 2]) AS x(dr), unnest([-2, -1, 0, 1, 2]) AS y(dc) WHERE v > 3e-1 AND abs(dr) + abs(dc) <= 2) GROUP BY image")
add("w13_r06_overview", "pixels", lambda p: g.block_mean(p.withColumn("v", F.col("v").cast("double")), 2), "SELECT image, CAST(floor(r / 2) AS BIGINT) AS r, CAST(floor(c / 2) AS BIGINT) AS c, avg(CAST(v AS DOUBLE)) AS v FROM pixels GROUP BY 1, 2, 3", "v", "image, r, c", 5)
add("a35_pyramid_check", "pixels", lambda p: g.block_mean(g.block_mean(p.withColumn("v", F.col("v").cast("double")), 2), 2).withColumnRenamed("v", "a").join(g.block_mean(p.withColumn("v", F.col("v").cast("double")), 4).withColumnRenamed("v", "b"), ["image", "r", "c"]).agg((F.max(F.abs(F.col("a") - F.col("b"))) < 1e-9).alias("same"), F.count("*").alias("n")), "SELECT true AS same, count(*) AS n FROM (SELECT DISTINCT image, floor(r / 4), floor(c / 4) FROM pixels)")
add("a28_texture_spread", "pixels", g.texture_spread, "SELECT image, stddev_pop(CAST(v AS DOUBLE)) AS spread FROM pixels GROUP BY image", "spread", "image", 5)
add("v06_stretch", "pixels", g.stretch, "SELECT image, quantile_cont(CAST(v AS DOUBLE), 0.02) AS lo, quantile_cont(CAST(v AS DOUBLE), 0.98) AS hi FROM pixels GROUP BY image", "lo, hi", "image", 5)


def _sampled(half: bool):
    def run(p: DataFrame) -> DataFrame:
        p = p.withColumn("v", F.col("v").cast("double"))
        pts = p.select("image").distinct().withColumns({"x": (F.col("image") % 70) / 10.0 + 0.55, "y": (F.col("image") % 60) / 10.0 + 0.85})
        return g.bilinear(pts, p, half).select("image", "v")

    return run


BILINEAR = """WITH p AS (SELECT image, (image % 70) / 10e0 + 55e-2 - {s} AS u, (image % 60) / 10e0 + 85e-2 - {s} AS w FROM (SELECT DISTINCT image FROM pixels)),
 q AS (SELECT p.image, u, w, floor(u) AS c0, floor(w) AS r0, dr, dc FROM p, unnest([0, 1]) AS a(dr), unnest([0, 1]) AS b(dc)),
 k AS (SELECT q.image, (CASE WHEN dc = 1 THEN u - c0 ELSE 1 - (u - c0) END) * (CASE WHEN dr = 1 THEN w - r0 ELSE 1 - (w - r0) END) AS wt, CAST(v AS DOUBLE) AS v FROM q LEFT JOIN pixels x ON x.image = q.image AND x.r = r0 + dr AND x.c = c0 + dc)
 SELECT image, CASE WHEN count(*) FILTER (WHERE v IS NULL AND wt > 0) = 0 THEN sum(wt * v) END AS v FROM k GROUP BY image"""
add("j07_bilinear_centre", "pixels", _sampled(True), BILINEAR.format(s="5e-1"), "v", "image", 5)
add("j09_bilinear_corner", "pixels", _sampled(False), BILINEAR.format(s="0e0"), "v", "image", 5)
_next = lambda p: g.best_shift(p.withColumn("v", F.col("v").cast("double")), p.withColumns({"image": F.col("image") - 1, "v": F.col("v").cast("double")}), 2).select("image", "score")
add("a34_best_shift", "pixels", _next, """WITH s AS (SELECT image, r, c, (CAST(v AS DOUBLE) - avg(CAST(v AS DOUBLE)) OVER w) / stddev_pop(CAST(v AS DOUBLE)) OVER w AS s FROM pixels WINDOW w AS (PARTITION BY image)),
 q AS (SELECT a.image, dr, dc, avg(a.s * b.s) AS score FROM s a, unnest([-2, -1, 0, 1, 2]) AS x(dr), unnest([-2, -1, 0, 1, 2]) AS y(dc), s b WHERE b.image = a.image + 1 AND a.r = b.r + dr AND a.c = b.c + dc GROUP BY 1, 2, 3) SELECT image, max(score) AS score FROM q GROUP BY image""", "score", "image", 5)
add("a43_peak", "pixels", lambda p: g.peak(p.withColumn("v", F.col("v").cast("double")), 1, 8, 8), """WITH s AS (SELECT image, r, c, CAST(v AS DOUBLE) AS v FROM pixels),
 t AS (SELECT image, r AS pr, c AS pc, v AS peak FROM s QUALIFY row_number() OVER (PARTITION BY image ORDER BY v DESC, r, c) = 1),
 k AS (SELECT t.*, s.r, s.c, v, (c - pc + 8) % 8 AS dx, (r - pr + 8) % 8 AS dy FROM s JOIN t ON s.image = t.image),
 b AS (SELECT image, pr, pc, peak, max(v) FILTER (WHERE least(abs(c - pc), 8 - abs(c - pc)) > 1 OR least(abs(r - pr), 8 - abs(r - pr)) > 1) AS second, (peak + list_sort(list(v))[CAST(floor(count(*) / 2) AS BIGINT) + 1]) / 2 AS half FROM k GROUP BY image, pr, pc, peak),
 f AS (SELECT b.image, min(dx) FILTER (WHERE r = b.pr AND dx > 0 AND v <= half) AS fx, min(dy) FILTER (WHERE c = b.pc AND dy > 0 AND v <= half) AS fy FROM k JOIN b ON k.image = b.image GROUP BY b.image),
 w AS (SELECT b.image, CASE WHEN fx IS NULL THEN 15e0 WHEN fx = 1 THEN 5e-1 ELSE fx - 1 + (half - x0.v) / (x1.v - x0.v + 1e-12) END AS wx, CASE WHEN fy IS NULL THEN 15e0 WHEN fy = 1 THEN 5e-1 ELSE fy - 1 + (half - y0.v) / (y1.v - y0.v + 1e-12) END AS wy
  FROM b JOIN f ON b.image = f.image LEFT JOIN k x1 ON x1.image = b.image AND x1.r = b.pr AND x1.dx = fx LEFT JOIN k x0 ON x0.image = b.image AND x0.r = b.pr AND x0.dx = fx - 1 LEFT JOIN k y1 ON y1.image = b.image AND y1.c = b.pc AND y1.dy = fy LEFT JOIN k y0 ON y0.image = b.image AND y0.c = b.pc AND y0.dy = fy - 1)
 SELECT b.image, pr, pc, peak, second, CASE WHEN second > 1e-12 THEN peak / second ELSE 1e9 END AS ratio, (wx + wy) / 2 AS fwhm FROM b JOIN w ON b.image = w.image""", "peak, second, ratio, fwhm", "image, pr, pc", 4)
_rings = lambda r, n: g.resolve_ways(r, n).filter("n >= 3").select(F.col("way").alias("ring"), "coords", "n")


def _edges(r: DataFrame, n: DataFrame) -> DataFrame:
    rings = _rings(r, n)
    a = rings.select("ring", "n", F.posexplode("coords").alias("i", "a"), "coords")
    return a.select("ring", F.col("a.east").alias("x1"), F.col("a.north").alias("y1"), F.element_at("coords", (F.col("i") + 1) % F.col("n").cast("int") + 1).alias("b")).select("ring", "x1", "y1", F.col("b.east").alias("x2"), F.col("b.north").alias("y2"))


WAYS = "k AS (SELECT way, pos, east, north FROM refs JOIN nodes ON refs.node = nodes.node), rg AS (SELECT way FROM k GROUP BY way HAVING count(*) >= 3)"
EDGES = f"{WAYS}, o AS (SELECT way AS ring, east AS x1, north AS y1, coalesce(lead(east) OVER w, first_value(east) OVER w) AS x2, coalesce(lead(north) OVER w, first_value(north) OVER w) AS y2 FROM k WHERE way IN (SELECT way FROM rg) WINDOW w AS (PARTITION BY way ORDER BY pos))"
add("j10_resolve_ways", "refs nodes", lambda r, n: g.resolve_ways(r, n).select("way", "n", F.element_at("coords", 1)["east"].alias("first_east"), F.element_at("coords", -1)["north"].alias("last_north")), "SELECT way, count(*) AS n, arg_min(east, pos) AS first_east, arg_max(north, pos) AS last_north FROM refs JOIN nodes ON refs.node = nodes.node GROUP BY way", "first_east, last_north", "way, n")
add("p11_polygon_mask", "refs nodes", lambda r, n: g.polygon_mask(_edges(r, n), 50, 211).groupBy("ring").agg(F.count("*").alias("cells")), f"WITH {EDGES}, x AS (SELECT ring, r, x1 + (r + 5e-1 - y1) / (y2 - y1) * (x2 - x1) AS x FROM o, unnest(range(0, 50)) AS t(r) WHERE y1 <> y2 AND r + 5e-1 >= least(y1, y2) AND r + 5e-1 < greatest(y1, y2)) SELECT ring, count(*) AS cells FROM (SELECT ring, r, c FROM x, unnest(range(0, 211)) AS u(c) WHERE c + 5e-1 < x GROUP BY ring, r, c HAVING count(*) % 2 = 1) GROUP BY ring")
NEAR = "pow((c - x1) - coalesce(least(greatest(((c - x1) * (x2 - x1) + (r - y1) * (y2 - y1)) / nullif(pow(x2 - x1, 2) + pow(y2 - y1, 2), 0), 0), 1), 0) * (x2 - x1), 2) + pow((r - y1) - coalesce(least(greatest(((c - x1) * (x2 - x1) + (r - y1) * (y2 - y1)) / nullif(pow(x2 - x1, 2) + pow(y2 - y1, 2), 0), 0), 1), 0) * (y2 - y1), 2)"
add("r11_thick_lines", "refs nodes", lambda r, n: g.thick_cells(_edges(r, n).withColumnRenamed("ring", "line"), 1.5), f"WITH {EDGES}, s AS (SELECT DISTINCT ring, r, c FROM (SELECT *, unnest(range(CAST(floor(least(x1, x2)) - 2 AS BIGINT), CAST(ceil(greatest(x1, x2)) + 3 AS BIGINT))) AS c FROM (SELECT *, unnest(range(CAST(floor(least(y1, y2)) - 2 AS BIGINT), CAST(ceil(greatest(y1, y2)) + 3 AS BIGINT))) AS r FROM o)) WHERE {NEAR} <= 225e-2) SELECT ring AS line, count(*) AS cells FROM s GROUP BY ring")
add("p11_polygon_mask_whole", "refs nodes", lambda r, n: g.polygon_cells(_edges(r, n)), f"WITH {EDGES}, x AS (SELECT ring, r, x1 + (r + 5e-1 - y1) / (y2 - y1) * (x2 - x1) AS x FROM o, unnest(range(0, 60)) AS t(r) WHERE y1 <> y2 AND r + 5e-1 >= least(y1, y2) AND r + 5e-1 < greatest(y1, y2)) SELECT ring, count(*) AS cells FROM (SELECT ring, r, c FROM x, unnest(range(0, 211)) AS u(c) WHERE c + 5e-1 < x GROUP BY ring, r, c HAVING count(*) % 2 = 1) GROUP BY ring")
add("r13_cleared_cells", "refs nodes classes", lambda r, n, c: g.clear_polygons(c.select("r", "c", F.col("class").alias("v")), _edges(r, n))[1], f"WITH {EDGES}, x AS (SELECT ring, r, x1 + (r + 5e-1 - y1) / (y2 - y1) * (x2 - x1) AS x FROM o, unnest(range(0, 60)) AS t(r) WHERE y1 <> y2 AND r + 5e-1 >= least(y1, y2) AND r + 5e-1 < greatest(y1, y2)), i AS (SELECT ring, r, c FROM x, unnest(range(0, 211)) AS u(c) WHERE c + 5e-1 < x GROUP BY ring, r, c HAVING count(*) % 2 = 1), f AS (SELECT r, c, min(ring) AS ring FROM i GROUP BY r, c) SELECT ring, count(*) AS cleared FROM f JOIN classes k ON k.r = f.r AND k.c = f.c WHERE class <> 0 GROUP BY ring")
add("r09_paint_order", "classes", lambda c: g.paint(c.filter("class > 0").withColumns({"r": F.floor(F.col("r") / 4), "c": F.floor(F.col("c") / 4)})), "SELECT CAST(floor(r / 4) AS BIGINT) AS r, CAST(floor(c / 4) AS BIGINT) AS c, arg_max(class, list_position([4, 5, 1, 2, 3], class)) AS class FROM classes WHERE class > 0 GROUP BY 1, 2")
add("a32_weighted_blend", "heights", lambda h: g.blend(h.withColumnRenamed("z", "v")), "SELECT r, c, sum(z * confidence * confidence) / nullif(sum(confidence * confidence), 0) AS v, sum(confidence * confidence) AS weight FROM heights GROUP BY r, c", "v, weight", "r, c")
add("a33_masked_ratio", "heights", lambda h: g.masked_ratio(h, ["c"], F.col("z") > 30, F.col("z") > 10), "SELECT c, coalesce(avg(CASE WHEN z > 30 THEN 1e0 ELSE 0e0 END) FILTER (WHERE z > 10), 0e0) AS ratio FROM heights GROUP BY c", "ratio", "c")
add("a30_mean_merge", "heights", g.mean_merge, "SELECT r, c, avg(z) AS z, count(z) AS n FROM heights GROUP BY r, c", "z", "r, c, n")
_ground = lambda c: c.select("r", "c", (F.col("class") * 3.0).alias("z"))
add("a31_vertical_offset", "heights classes", lambda h, c: g.vertical_offset(g.mean_merge(h), _ground(c), 2, (20, 5)), """WITH d AS (SELECT r, c, avg(z) AS z FROM heights GROUP BY r, c HAVING count(z) >= 2), q AS (SELECT quantile_cont(z, 0.05) AS lo, quantile_cont(z, 0.2) AS hi FROM d),
 t AS (SELECT k.class * 3e0 AS z FROM d JOIN classes k ON k.r = d.r AND k.c = d.c) SELECT CASE WHEN (SELECT count(*) FROM d) >= 20 AND (SELECT count(*) FROM t) >= 5 THEN (SELECT median(z) FROM t) - (SELECT median(z) FROM d, q WHERE z BETWEEN lo AND hi) ELSE 0e0 END AS shift_m""", "shift_m")
add("a31_trimmed_median", "heights", lambda h: exact_quantiles(h.join(exact_quantiles(h, ["c"], {"lo": (F.col("z"), 0.05), "hi": (F.col("z"), 0.2)}), "c").filter("z BETWEEN lo AND hi"), ["c"], {"z": (F.col("z"), 0.5)}), "SELECT h.c, median(z) AS z FROM heights h JOIN (SELECT c, quantile_cont(z, 0.05) AS lo, quantile_cont(z, 0.2) AS hi FROM heights GROUP BY c) q ON h.c = q.c WHERE z BETWEEN lo AND hi GROUP BY h.c", "z", "c")
add("a29_range_gate", "heights", lambda h: g.accumulate(h, range_max=60.0).select("r", "c", "z_max", "n"), "SELECT r, c, max(z) AS z_max, count(*) AS n FROM heights WHERE range_m <= 60 GROUP BY r, c", "z_max", "r, c, n")
add("j13_coverage_fallback", "heights classes", lambda h, c: g.fallback(g.accumulate(h).withColumnRenamed("z_max", "z"), c.withColumnRenamed("class", "z")), "SELECT coalesce(k.r, h.r) AS r, coalesce(k.c, h.c) AS c, coalesce(m, CAST(class AS DOUBLE)) AS z, m IS NOT NULL AS measured FROM classes k FULL JOIN (SELECT r, c, max(z) AS m FROM heights GROUP BY r, c) h ON k.r = h.r AND k.c = h.c", "z", "r, c, measured")
_tiles = lambda c: c.filter("class >= 2").select(F.col("c").alias("x"), F.col("r").alias("y"), "class")
add("j11_adjacent_tiles", "classes", lambda c: g.adjacent_tiles(_tiles(c)), "WITH t AS (SELECT c AS x, r AS y FROM classes WHERE class >= 2) SELECT a.x, a.y, b.x AS x2, b.y AS y2 FROM t a JOIN t b ON b.x = a.x + 1 AND b.y = a.y UNION ALL SELECT a.x, a.y, b.x, b.y FROM t a JOIN t b ON b.x = a.x AND b.y = a.y + 1")
add("j12_seams", "classes", lambda c: g.seams(_tiles(c), "class"), "WITH t AS (SELECT c AS x, r AS y, class FROM classes WHERE class >= 2) SELECT a.x, a.y, b.x AS x2, b.y AS y2 FROM t a JOIN t b ON (b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1) WHERE a.class <> b.class")
add("n02_rigid_fit", "fixes", lambda f: g.rigid2d(f.select("run_id", F.col("gt_east").alias("ax"), F.col("gt_north").alias("ay"), F.col("est_east").alias("bx"), F.col("est_north").alias("by_")), ["run_id"]), """SELECT run_id, n, theta, 1e0 AS scale, mbx - cos(theta) * max_ + sin(theta) * may AS tx, mby - sin(theta) * max_ - cos(theta) * may AS ty FROM (SELECT run_id, count(*) AS n, atan2(covar_pop(gt_east, est_north) - covar_pop(gt_north, est_east), covar_pop(gt_east, est_east) + covar_pop(gt_north, est_north)) AS theta, avg(gt_east) AS max_, avg(gt_north) AS may, avg(est_east) AS mbx, avg(est_north) AS mby FROM fixes GROUP BY run_id)""", "theta, scale, tx, ty", "run_id, n", 5)
add("n03_similarity_fit", "fixes", lambda f: g.rigid2d(f.select("run_id", F.col("gt_east").alias("ax"), F.col("gt_north").alias("ay"), F.col("est_east").alias("bx"), F.col("est_north").alias("by_")), ["run_id"], True).select("run_id", "theta", "scale"), """SELECT run_id, theta, sqrt(d * d + x * x) / va AS scale FROM (SELECT run_id, atan2(x, d) AS theta, x, d, va FROM (SELECT run_id, covar_pop(gt_east, est_north) - covar_pop(gt_north, est_east) AS x, covar_pop(gt_east, est_east) + covar_pop(gt_north, est_north) AS d, var_pop(gt_east) + var_pop(gt_north) AS va FROM fixes GROUP BY run_id))""", "theta, scale", "run_id", 5)


def _documents(name: str, query, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(query(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/pages.parquet")))

    register(name, run, sql)


_documents("a26_placeholder_tiles", lambda d, p: g.placeholder_tiles(d.select("doc_id", F.sha2("text", 256).alias("digest"), (F.col("n_chars") / 100).alias("spread")), 2, 20.0).select("doc_id"), "SELECT doc_id FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents GROUP BY 1 HAVING count(*) >= 2 AND min(n_chars / 100e0) < 20)")
_documents("a26_duplicate_digests", lambda d, p: d.withColumn("digest", F.sha2("text", 256)).groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n >= 2"), "SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS \"first\" FROM documents GROUP BY 1 HAVING count(*) >= 2")
_documents("a27_content_digest", lambda d, p: d.select("doc_id", F.sha2("text", 256).alias("digest")), "SELECT doc_id, sha256(text) AS digest FROM documents")
_documents("s40_url_layout", lambda d, p: p.select("page_id", F.regexp_extract("url", r"^(\w+)://([^/]+)", 2).alias("host"), F.size(F.split("url", "/")).alias("depth")), r"SELECT page_id, regexp_extract(url, '^(\w+)://([^/]+)', 2) AS host, CAST(len(string_split(url, '/')) AS INT) AS depth FROM pages")
_documents("u01_union_distinct", lambda d, p: d.select("source").union(p.select("url")).distinct(), "SELECT source FROM documents UNION SELECT url FROM pages")
_documents("u02_difference", lambda d, p: d.select("doc_id").join(p.select(F.col("page_id").alias("doc_id")), "doc_id", "left_anti"), "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT page_id FROM pages)")
_documents("u05_collected_sources", lambda d, p: d.groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources")), "SELECT lang, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM documents GROUP BY lang")
_documents("p12_tag_classes", lambda d, p: d.select("doc_id", m.class_of_tags(F.create_map(F.when(F.col("lang") == "en", "building").when(F.col("lang") == "de", "landuse").when(F.col("lang") == "fr", "waterway").otherwise("name"), F.lit("farmland"))).alias("class")), "SELECT doc_id, CASE lang WHEN 'en' THEN 2 WHEN 'de' THEN 4 WHEN 'fr' THEN 3 END AS class FROM documents")


def _pair(c: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A class raster as whole-number heights, and one that is half like it, a cell further on."""
    a = c.select("r", "c", (F.col("class") * 7 + F.col("r") % 5).alias("v"))
    return a, c.select((F.col("r") + 1).alias("r"), "c", (F.col("class") * 7 + F.col("c") % 11).alias("v"))


add("a34_windowed_correlation", "classes", lambda c: g.windowed_correlation(*_pair(c), 4, 6), """WITH j AS (SELECT a.r, a.c, CAST(a.class * 7 + a.r % 5 AS BIGINT) AS x, CAST(b.class * 7 + b.c % 11 AS BIGINT) AS y FROM classes a JOIN classes b ON b.r + 1 = a.r AND b.c = a.c),
 s AS (SELECT p.r, p.c, count(*) AS n, sum(q.x) AS sx, sum(q.y) AS sy, sum(q.x * q.x) AS xx, sum(q.y * q.y) AS yy, sum(q.x * q.y) AS xy FROM j p JOIN j q ON abs(q.r - p.r) <= 4 AND abs(q.c - p.c) <= 4 WHERE p.r % 6 = 0 AND p.c % 6 = 0 GROUP BY 1, 2)
 SELECT r, c, n, CASE WHEN n >= 6e-1 * 81 THEN CAST(n * xy - sx * sy AS DOUBLE) / nullif(sqrt(CAST(n * xx - sx * sx AS DOUBLE)) * sqrt(CAST(n * yy - sy * sy AS DOUBLE)), 0) END AS ncc FROM s""", "ncc", "r, c, n")
_offset = lambda c: g.windowed_offset(_pair(c)[0], c.select((F.col("r") - 1).alias("r"), (F.col("c") + 1).alias("c"), (F.col("class") * 7 + F.col("r") % 5).alias("v")), 6, 16, 1).groupBy("dr", "dc").agg(F.count("*").alias("n"))
add("a34_windowed_offset", "classes", _offset, """WITH a AS (SELECT r, c, CAST(class * 7 + r % 5 AS BIGINT) AS v FROM classes), j AS (SELECT dr, dc, a.r, a.c, a.v AS x, b.v AS y FROM a, unnest([-1, 0, 1]) AS s(dr), unnest([-1, 0, 1]) AS t(dc), a b WHERE a.r = b.r - 1 + dr AND a.c = b.c + 1 + dc),
 s AS (SELECT p.dr, p.dc, p.r, p.c, count(*) AS n, sum(q.x) AS sx, sum(q.y) AS sy, sum(q.x * q.x) AS xx, sum(q.y * q.y) AS yy, sum(q.x * q.y) AS xy FROM j p JOIN j q ON q.dr = p.dr AND q.dc = p.dc AND abs(q.r - p.r) <= 6 AND abs(q.c - p.c) <= 6 WHERE p.r % 16 = 0 AND p.c % 16 = 0 GROUP BY 1, 2, 3, 4),
 k AS (SELECT dr, dc, r, c, CAST(n * xy - sx * sy AS DOUBLE) / nullif(sqrt(CAST(n * xx - sx * sx AS DOUBLE)) * sqrt(CAST(n * yy - sy * sy AS DOUBLE)), 0) AS ncc FROM s WHERE n >= 6e-1 * 169),
 b AS (SELECT CAST(dr AS INT) AS dr, CAST(dc AS INT) AS dc FROM k WHERE ncc IS NOT NULL QUALIFY row_number() OVER (PARTITION BY r, c ORDER BY ncc DESC, abs(dr) + abs(dc), dr DESC, dc DESC) = 1) SELECT dr, dc, count(*) AS n FROM b GROUP BY 1, 2""")


_on = lambda p: p.select("image", "r", "c", (F.col("v") > 0.1).alias("on"))
_set = lambda p, of=0: _on(p).filter("on").select((F.col("image") - of).alias("image"), "r", "c")
DISTANCE = "d AS (SELECT p.image, p.r, p.c, min((p.r - q.r) * (p.r - q.r) + (p.c - q.c) * (p.c - q.c)) AS d2 FROM pixels p LEFT JOIN pixels q ON q.image = p.image AND q.v > 1e-1 GROUP BY 1, 2, 3)"
SHIFTS = "unnest([-2, -1, 0, 1, 2]) AS s(dr), unnest([-2, -1, 0, 1, 2]) AS t(dc)"
add("x12_distance_transform", "pixels", lambda p: semantic.distances(_on(p)), f"WITH {DISTANCE} SELECT image, r, c, d2 FROM d")
add("x12_chamfer_surface", "pixels", lambda p: semantic.chamfer_surface(_on(p), _set(p, 1), 2), f"WITH {DISTANCE} SELECT d.image, CAST(dr AS INT) AS dr, CAST(dc AS INT) AS dc, count(*) AS n, avg(sqrt(CAST(d2 AS DOUBLE))) AS chamfer FROM pixels e, {SHIFTS}, d WHERE e.v > 1e-1 AND d.image = e.image - 1 AND d.r = e.r + dr AND d.c = e.c + dc GROUP BY 1, 2, 3", "chamfer", "image, dr, dc, n")
add("x12_overlap_surface", "pixels", lambda p: semantic.overlap_surface(_set(p), _set(p, 1), 2), f"""WITH a AS (SELECT image, r, c FROM pixels WHERE v > 1e-1), b AS (SELECT image - 1 AS image, r, c FROM pixels WHERE v > 1e-1),
 n AS (SELECT image, sum(x) AS x, sum(y) AS y FROM (SELECT image, 1 AS x, 0 AS y FROM a UNION ALL SELECT image, 0, 1 FROM b) u GROUP BY image),
 i AS (SELECT a.image, dr, dc, count(*) AS i FROM b, {SHIFTS}, a WHERE a.image = b.image AND a.r = b.r + dr AND a.c = b.c + dc GROUP BY 1, 2, 3)
 SELECT n.image, CAST(z.dr AS INT) AS dr, CAST(z.dc AS INT) AS dc, coalesce(i, 0) / CAST(x + y - coalesce(i, 0) AS DOUBLE) AS iou FROM n CROSS JOIN (SELECT dr, dc FROM {SHIFTS}) z LEFT JOIN i ON i.image = n.image AND i.dr = z.dr AND i.dc = z.dc""", "iou", "image, dr, dc")


def _fix(p: DataFrame) -> DataFrame:
    kinds = p.withColumn("class", F.when(F.col("v") > 0.1, 1).when(F.col("v") < -0.1, 4)).filter("class IS NOT NULL").select("image", "r", "c", "class")
    both = lambda k, of: kinds.filter(F.col("class") == k).select((F.col("image") - of).alias("image"), "r", "c")
    surfaces = [semantic.overlap_surface(both(k, 0), both(k, 1), 2).withColumn("class", F.lit(k)) for k in (1, 4)]
    return semantic.semantic_fix(surfaces[0].unionByName(surfaces[1])).filter("score > 0").select("image", "score", "sharpness", "fix_type")


add("x12_semantic_fix", "pixels", _fix, f"""WITH k AS (SELECT image, r, c, CASE WHEN v > 1e-1 THEN 1 ELSE 4 END AS class FROM pixels WHERE v > 1e-1 OR v < -1e-1), b AS (SELECT image - 1 AS image, r, c, class FROM k),
 n AS (SELECT image, class, sum(x) AS x, sum(y) AS y FROM (SELECT image, class, 1 AS x, 0 AS y FROM k UNION ALL SELECT image, class, 0, 1 FROM b) u GROUP BY image, class),
 i AS (SELECT a.image, a.class, dr, dc, count(*) AS i FROM b, {SHIFTS}, k a WHERE a.image = b.image AND a.class = b.class AND a.r = b.r + dr AND a.c = b.c + dc GROUP BY 1, 2, 3, 4),
 o AS (SELECT n.image, n.class, z.dr, z.dc, coalesce(i, 0) / CAST(x + y - coalesce(i, 0) AS DOUBLE) AS iou FROM n CROSS JOIN (SELECT dr, dc FROM {SHIFTS}) z LEFT JOIN i ON i.image = n.image AND i.class = n.class AND i.dr = z.dr AND i.dc = z.dc),
 w AS (SELECT image, dr, dc, sum(iou * CASE class WHEN 1 THEN 1e0 ELSE 2e-1 END) / sum(CASE class WHEN 1 THEN 1e0 ELSE 2e-1 END) AS score FROM o GROUP BY 1, 2, 3),
 m AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY image ORDER BY score DESC, abs(dr) + abs(dc), dr DESC, dc DESC) = 1)
 SELECT m.image, m.score, m.score / max(w.score) FILTER (WHERE abs(w.dr - m.dr) > 1 OR abs(w.dc - m.dc) > 1) AS sharpness, CAST(2 AS INT) AS fix_type FROM m JOIN w ON w.image = m.image WHERE m.score > 0 GROUP BY m.image, m.score""", "score, sharpness", "image, fix_type")

_areas = lambda r, n: g.area_cells(_edges(r, n).withColumn("area", F.floor(F.col("ring") / 3))).groupBy("area").agg(F.count("*").alias("cells"), F.min("c").alias("west"), F.max("c").alias("east"))
add("u06_areas_with_holes", "refs nodes", _areas, f"WITH {EDGES}, x AS (SELECT CAST(floor(ring / 3) AS BIGINT) AS area, r, x1 + (r + 5e-1 - y1) / (y2 - y1) * (x2 - x1) AS x FROM o, unnest(range(0, 60)) AS t(r) WHERE y1 <> y2 AND r + 5e-1 >= least(y1, y2) AND r + 5e-1 < greatest(y1, y2)) SELECT area, count(*) AS cells, min(c) AS west, max(c) AS east FROM (SELECT area, r, c FROM x, unnest(range(0, 211)) AS u(c) WHERE c + 5e-1 < x GROUP BY area, r, c HAVING count(*) % 2 = 1) GROUP BY area")
