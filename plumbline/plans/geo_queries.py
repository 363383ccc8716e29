"""Queries of geodetic, tile, rotation and imaging functions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geodesy as g
from ..functions import imaging as im
from ..functions import rotation as rot
from .tools import add

RAD = "p AS (SELECT *, radians(lat_deg) AS la, radians(lon_deg) AS lo FROM points)"
N = f"({g.A!r}e0 / sqrt(1 - {g.E2!r}e0 * sin(la) * sin(la)))"
class _Lazy:
    """Columns by name, made when a query is built: none can be made without a session."""

    la = property(lambda _: F.radians("lat_deg"))
    lo = property(lambda _: F.radians("lon_deg"))
    x, y, z = (property(lambda _, n=n: F.col(n)) for n in "xyz")


k = _Lazy()
ANCHOR = (math.radians(44.0), math.radians(39.0), 100.0)

add("f08_ecef", "points", lambda p: p.select("id", g.ecef(k.la, k.lo, F.col("alt")).alias("e")).select("id", "e.*"), f"WITH {RAD} SELECT id, ({N} + alt) * cos(la) * cos(lo) AS x, ({N} + alt) * cos(la) * sin(lo) AS y, ({N} * (1 - {g.E2!r}e0) + alt) * sin(la) AS z FROM p", "x, y, z", "id", 4)
add("f09_geodetic_round_trip", "points", lambda p: p.select("id", g.ecef(k.la, k.lo, F.col("alt")).alias("e"), "alt").select("id", g.geodetic(F.col("e.x"), F.col("e.y"), F.col("e.z")).alias("q")).select("id", F.degrees("q.lat").alias("lat"), F.degrees("q.lon").alias("lon"), F.col("q.alt").alias("alt")), "SELECT id, lat_deg AS lat, lon_deg AS lon, alt FROM points", "lat, lon, alt", "id", 5)
add("f10_enu_round_trip", "points", lambda p: p.select("id", g.to_enu(k.la, k.lo, F.col("alt"), ANCHOR).alias("e")).select("id", g.from_enu(F.col("e.east"), F.col("e.north"), F.col("e.up"), ANCHOR).alias("q")).select("id", F.degrees("q.lat").alias("lat"), F.degrees("q.lon").alias("lon"), F.col("q.alt").alias("alt")), "SELECT id, lat_deg AS lat, lon_deg AS lon, alt FROM points", "lat, lon, alt", "id", 5)
add("f12_utm_round_trip", "points", lambda p: p.select("id", g.utm(k.la, k.lo, 37).alias("u")).select("id", g.utm_inverse(F.col("u.easting"), F.col("u.northing"), 37).alias("q")).select("id", F.degrees("q.lat").alias("lat"), F.degrees("q.lon").alias("lon")), "SELECT id, lat_deg AS lat, lon_deg AS lon FROM points", "lat, lon", "id", 7)
_e = math.sqrt(g.E2)
TAUP = f"sqrt(1 + pow(sinh({_e!r}e0 * atanh({_e!r}e0 * tan(la) / sqrt(1 + tan(la) * tan(la)))), 2)) * tan(la) - sinh({_e!r}e0 * atanh({_e!r}e0 * tan(la) / sqrt(1 + tan(la) * tan(la)))) * sqrt(1 + tan(la) * tan(la))"
XI = " + ".join(["x1", *(f"({a!r}) * sin({2 * i} * x1) * cosh({2 * i} * e1)" for i, a in enumerate(g.ALPHA, 1))])
ETA = " + ".join(["e1", *(f"({a!r}) * cos({2 * i} * x1) * sinh({2 * i} * e1)" for i, a in enumerate(g.ALPHA, 1))])
K = g.K0 * g.RECTIFYING
add("f11_utm_forward", "points", lambda p: p.select("id", g.utm(k.la, k.lo, 37).alias("u")).select("id", "u.*"), f"WITH {RAD}, t AS (SELECT id, {TAUP} AS tp, lo - radians(39) AS d FROM p), s AS (SELECT id, atan2(tp, cos(d)) AS x1, asinh(sin(d) / sqrt(tp * tp + cos(d) * cos(d))) AS e1 FROM t) SELECT id, 500000 + {K!r}e0 * ({ETA}) AS easting, {K!r}e0 * ({XI}) AS northing FROM s", "easting, northing", "id", 4)
add("f14_f15_zone", "points", lambda p: p.select("id", g.zone_of_epsg(F.concat(F.lit("EPSG:326"), F.lpad((F.col("id") % 60 + 1).cast("string"), 2, "0"))).alias("zone")).withColumn("meridian", F.degrees(g.central_meridian(F.col("zone")))), "SELECT id, CAST(id % 60 + 1 AS INT) AS zone, (id % 60 + 1) * 6e0 - 183 AS meridian FROM points", "meridian", "id, zone")
TILE = """t AS (SELECT id, z, pow(2e0, z) AS n, lon_deg, greatest(-85.0511287798066e0, least(85.0511287798066e0, lat_deg)) AS la FROM points),
 xy AS (SELECT id, z, n, la, CAST(greatest(0, least(n - 1, floor((lon_deg + 180) / 360 * n))) AS BIGINT) AS x, CAST(greatest(0, least(n - 1, floor((1 - asinh(tan(radians(la))) / pi()) / 2 * n))) AS BIGINT) AS y FROM t)"""
_tile = lambda p: p.select("id", "z", "lat_deg", g.tile_of(F.col("lon_deg"), F.col("lat_deg"), F.col("z")).alias("t")).select("id", "z", "lat_deg", F.col("t.x").alias("x"), F.col("t.y").alias("y"))
add("f21_tile_of_point", "points", lambda p: _tile(p).select("id", "x", "y"), f"WITH {TILE} SELECT id, x, y FROM xy")
add("f22_tile_centre", "points", lambda p: _tile(p).select("id", g.tile_center(k.x, k.y, k.z).alias("c")).select("id", "c.*"), f"WITH {TILE} SELECT id, (x + 5e-1) / n * 360 - 180 AS lon, degrees(atan(sinh(pi() * (1 - 2 * (y + 5e-1) / n)))) AS lat FROM xy", "lon, lat", "id")
add("f23_tile_bounds", "points", lambda p: _tile(p).select("id", g.tile_bounds(k.x, k.y, k.z).alias("b")).select("id", "b.*"), f"WITH {TILE}, s AS (SELECT id, x, y, {2 * g.HALF_CIRCLE!r}e0 / n AS s FROM xy) SELECT id, x * s - {g.HALF_CIRCLE!r}e0 AS west, {g.HALF_CIRCLE!r}e0 - y * s - s AS south, x * s - {g.HALF_CIRCLE!r}e0 + s AS east, {g.HALF_CIRCLE!r}e0 - y * s AS north FROM s", "west, south, east, north", "id", 4)
add("f24_tile_corners", "points", lambda p: _tile(p).select("id", F.posexplode(g.tile_corners(k.x, k.y, k.z)).alias("corner", "c")).select("id", "corner", "c.lon", "c.lat"), f"WITH {TILE} SELECT id, c AS corner, (x * s - {g.HALF_CIRCLE!r}e0 + CASE WHEN c IN (1, 2) THEN s ELSE 0 END) / {g.HALF_CIRCLE!r}e0 * 180 AS lon, degrees(atan(sinh(pi() * (1 - 2 * (y + CASE WHEN c IN (2, 3) THEN 1 ELSE 0 END) / n)))) AS lat FROM (SELECT *, {2 * g.HALF_CIRCLE!r}e0 / n AS s FROM xy), unnest([CAST(0 AS INT), 1, 2, 3]) AS u(c)", "lon, lat", "id, corner", 9)
add("f25_ground_distance", "points", lambda p: p.select("id", g.ground_distance(F.col("lat_deg"), k.z).alias("m")), f"WITH {TILE} SELECT id, {2 * g.HALF_CIRCLE / 256!r}e0 / n * cos(radians(la)) AS m FROM xy", "m", "id")
add("f26_quadkey", "points", lambda p: _tile(p).select("id", g.quadkey(k.x, k.y, k.z).alias("key")), f"WITH {TILE} SELECT id, list_aggregate(list_transform(range(z, 0, -1), lambda i: CAST(((x >> (i - 1)) & 1) + 2 * ((y >> (i - 1)) & 1) AS VARCHAR)), 'string_agg', '') AS key FROM xy")
add("f27_quadkey_round_trip", "points", lambda p: _tile(p).select("id", g.quadkey_tile(g.quadkey(k.x, k.y, k.z)).alias("t")).select("id", "t.x", "t.y", "t.z"), f"WITH {TILE} SELECT id, x, y, z FROM xy")
add("r01_tile_cover", "points", lambda p: _tile(p).select("id", F.explode(F.sequence(k.x - 1, k.x + 1)).alias("x"), "y").select("id", "x", F.explode(F.sequence(k.y - 1, k.y + 1)).alias("y")).groupBy("x", "y").agg(F.count("*").alias("n")), f"WITH {TILE} SELECT a AS x, b AS y, count(*) AS n FROM xy, unnest([x - 1, x, x + 1]) AS u(a), unnest([y - 1, y, y + 1]) AS v(b) GROUP BY a, b")
add("f28_f34_pixel_grid", "points", lambda p: p.select("id", (F.floor(F.col("alt") / 0.5) * 0.5).alias("snapped"), ((F.col("alt") + 1000) / 0.5 - 0.5).alias("col"), F.greatest(F.lit(0), F.least(F.lit(4000), F.floor((F.col("alt") + 1000) / 0.5))).alias("clamped")), "SELECT id, floor(alt / 5e-1) * 5e-1 AS snapped, (alt + 1000) / 5e-1 - 5e-1 AS col, CAST(greatest(0, least(4000, floor((alt + 1000) / 5e-1))) AS BIGINT) AS clamped FROM points", "snapped, col", "id, clamped", 5)
add("f60_dem_tile_names", "points", lambda p: p.select("id", F.format_string("N%02dE%03d", F.floor("lat_deg"), F.floor("lon_deg")).alias("name")), "SELECT id, 'N' || lpad(CAST(CAST(floor(lat_deg) AS INT) AS VARCHAR), 2, '0') || 'E' || lpad(CAST(CAST(floor(lon_deg) AS INT) AS VARCHAR), 3, '0') AS name FROM points")
add("f64_cache_path", "points", lambda p: _tile(p).select("id", F.concat_ws("/", k.z, k.x, F.concat(k.y, F.lit(".jpg"))).alias("path")), f"WITH {TILE} SELECT id, CAST(z AS VARCHAR) || '/' || CAST(x AS VARCHAR) || '/' || CAST(y AS VARCHAR) || '.jpg' AS path FROM xy")
add("k07_pyramid_level", "points", lambda p: p.select("id", F.coalesce(F.array_max(F.filter(F.array(*map(F.lit, (0.5, 1.0, 2.0, 4.0))), lambda v: v <= F.abs(F.col("alt")) / 2000)), F.lit(0.5)).alias("gsd")), "SELECT id, coalesce(list_max(list_filter([5e-1, 1e0, 2e0, 4e0], lambda v: v <= abs(alt) / 2000)), 5e-1) AS gsd FROM points", "gsd", "id")

_q = lambda: rot.quaternion(F.cos(k.la / 2), F.sin(k.la / 2) * F.cos(k.lo), F.sin(k.la / 2) * F.sin(k.lo), F.lit(0.0))
add("f39_f40_quaternion_round_trip", "points", lambda p: p.select("id", rot.from_matrix(rot.to_matrix(_q())).alias("q")).select("id", "q.w", "q.x", "q.y"), f"WITH {RAD} SELECT id, cos(la / 2) AS w, sin(la / 2) * cos(lo) AS x, sin(la / 2) * sin(lo) AS y FROM p", "w, x, y", "id")
add("f41_slerp", "points", lambda p: p.select("id", rot.slerp(rot.quaternion(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)), rot.quaternion(F.cos(k.la / 2), F.lit(0.0), F.lit(0.0), F.sin(k.la / 2)), F.lit(0.25)).alias("q")).select("id", "q.w", "q.z"), f"WITH {RAD} SELECT id, cos(la / 8) AS w, sin(la / 8) AS z FROM p", "w, z", "id", 5)
add("f43_heading_rotation", "points", lambda p: p.select("id", rot.rotate(rot.heading3(k.lo), F.col("alt"), F.lit(1.0), F.lit(2.0)).alias("v")).select("id", "v.*"), f"WITH {RAD} SELECT id, alt * cos(lo) - sin(lo) AS x, alt * sin(lo) + cos(lo) AS y, 2e0 AS z FROM p", "x, y, z", "id")
LENS = (-0.05, 0.01, 0.001, -0.002)
_xy = lambda: (F.col("alt") / 20000, (F.col("lat_deg") - 45) / 20)
add("f46_distortion", "points", lambda p: p.select("id", im.distort(*_xy(), *LENS).alias("d")).select("id", "d.*"), "WITH q AS (SELECT id, alt / 20000 AS u, (lat_deg - 45) / 20 AS v FROM points), r AS (SELECT *, u * u + v * v AS r2 FROM q) SELECT id, u * (1 - 5e-2 * r2 + 1e-2 * r2 * r2) + 2e-3 * u * v - 2e-3 * (r2 + 2 * u * u) AS x, v * (1 - 5e-2 * r2 + 1e-2 * r2 * r2) + 1e-3 * (r2 + 2 * v * v) - 4e-3 * u * v AS y FROM r", "x, y", "id", 8)
add("f47_undistortion", "points", lambda p: p.select("id", im.distort(*_xy(), *LENS).alias("d")).select("id", im.undistort(F.col("d.x"), F.col("d.y"), *LENS).alias("u")).select("id", "u.*"), "SELECT id, alt / 20000 AS x, (lat_deg - 45) / 20 AS y FROM points", "x, y", "id", 8)
add("f48_project", "points", lambda p: p.select("id", im.project(F.col("alt") / 100, F.lit(2.0), F.col("lat_deg"), 800.0, 810.0, 320.0, 240.0).alias("q")).select("id", "q.*"), "SELECT id, 800 * (alt / 100 / lat_deg) + 320 AS u, 810 * (2 / lat_deg) + 240 AS v FROM points", "u, v", "id")
add("f49_f66_ground_hit", "points", lambda p: p.select("id", im.ground_hit(F.col("lon_deg"), F.col("lat_deg"), F.lit(100.0), F.col("alt") / 1000, F.lit(0.5), F.lit(-2.0)).alias("h")).select("id", "h.x", "h.y"), "SELECT id, lon_deg + 50 * alt / 1000 AS x, lat_deg + 25e0 AS y FROM points", "x, y", "id")
_v = lambda: F.pmod(F.col("alt"), F.lit(255.0))
V = "(abs(alt) - 255 * floor(abs(alt) / 255))"
_w = lambda: F.pmod(F.abs("alt"), F.lit(255.0))
add("f53_f56_photometric", "points", lambda p: p.select("id", im.gamma(_w(), 1.4).alias("gamma"), im.contrast(_w(), 1.3).alias("contrast"), im.haze(_w(), 0.2).alias("haze"), im.gain(_w(), 1.1).alias("gain")), f"SELECT id, least(255, greatest(0, pow({V} / 255, 1 / 14e-1) * 255)) AS gamma, least(255, greatest(0, ({V} - 128) * 13e-1 + 128)) AS contrast, least(255, greatest(0, {V} * 8e-1 + 36e0)) AS haze, least(255, greatest(0, {V} * 11e-1)) AS gain FROM points", "gamma, contrast, haze, gain", "id", 5)
add("f57_vignette", "points", lambda p: p.select("id", im.vignette(_w(), F.col("id") % 64, F.col("id") % 48, 64, 48, 0.5).alias("v")), f"SELECT id, {V} * (1 - 5e-1 * pow(least(1, sqrt(pow((id % 48 + 5e-1) / 48 - 5e-1, 2) + pow((id % 64 + 5e-1) / 64 - 5e-1, 2)) / 7071e-4), 2)) AS v FROM points", "v", "id", 5)
add("f58_season", "points", lambda p: p.select("id", im.season(_w(), _w(), _w(), 0.4).alias("s")).select("id", "s.*"), f"SELECT id, least(255, {V} * 6e-1 + ({V} * 9e-1 + 25) * 4e-1) AS r, {V} * 6e-1 + {V} * 85e-2 * 4e-1 AS g, least(255, {V} * 6e-1 + ({V} * 7e-1 + 30) * 4e-1) AS b FROM points", "r, g, b", "id", 5)
add("f50_gray", "points", lambda p: p.select("id", im.gray_int(F.col("id") % 256, (F.col("id") * 7) % 256, (F.col("id") * 13) % 256).alias("gray")), "SELECT id, CAST((299 * (id % 256) + 587 * ((id * 7) % 256) + 114 * ((id * 13) % 256) + 500) // 1000 AS BIGINT) AS gray FROM points")
M = "4294967295"
HASH = f"h1 AS (SELECT id, ((({{x}}) & {M})::HUGEINT * 374761393 + (({{y}}) & {M})::HUGEINT * 668265263) & {M} AS n FROM points), h2 AS (SELECT id, ((xor(n, n >> 13)) * 1274126177) & {M} AS n FROM h1), h3 AS (SELECT id, CAST((xor(n, n >> 16)) & 65535 AS DOUBLE) / 65535e0 AS h FROM h2)"
NOISE = HASH.format(x="CAST(floor(lon_deg * 100 * {f}) AS BIGINT)::HUGEINT", y="CAST(floor(alt * {f}) AS BIGINT)::HUGEINT")
_en = lambda: (F.col("lon_deg") * 100, F.col("alt"))
add("f51_hash_noise", "points", lambda p: p.select("id", im.hash_unit(F.col("id"), F.col("id") * 3 - 500).alias("h")), "WITH " + HASH.format(x="id::HUGEINT", y="(id * 3 - 500)::HUGEINT") + " SELECT id, h FROM h3", "h", "id", 9)
add("f52_value_noise", "points", lambda p: p.select("id", im.value_noise(*_en(), 0.4, 0).alias("h")), "WITH " + NOISE.format(f="4e-1") + " SELECT id, h FROM h3", "h", "id", 9)
add("g14_water_texture", "points", lambda p: p.select("id", im.texture("water", *_en()).alias("t")).select("id", "t.g"), "WITH " + NOISE.format(f="15e-2") + " SELECT id, 40 + 4 * (2 * h - 1) AS g FROM h3", "g", "id", 6)
add("g15_forest_texture", "points", lambda p: p.select("id", im.texture("forest", *_en(), second=True).alias("t")).select("id", "t.*"), "WITH " + NOISE.format(f="15e-1") + " SELECT id, least(255, (40 + 160 * h) * 6e-1) AS r, least(255, 40 + 160 * h) AS g, (40 + 160 * h) * 35e-2 AS b FROM h3", "r, g, b", "id", 6)
SEEDED = HASH.format(x="(CAST(floor(lon_deg * 100 * {f}) AS BIGINT) + 3)::HUGEINT", y="CAST(floor(alt * {f}) AS BIGINT)::HUGEINT") + ", p AS (SELECT id, lon_deg * 100 AS e, alt AS n FROM points)"
_cell = "((CAST(floor(e / 25) AS BIGINT) + 2 * CAST(floor(n / 25) AS BIGINT)) % 4 + 4) % 4"
_box = lambda x, y, w, h: f"abs(e - {x}) < {w} AND abs(n - ({y})) < {h}"
_clip = lambda v: f"least(255, greatest(0, {v}))"
SECOND_VIEWS = {
    "periodic": ("1e0", f"(CASE {_cell} WHEN 0 THEN 60e0 WHEN 1 THEN 140e0 WHEN 2 THEN 90e0 ELSE 170e0 END + 12 * (2 * h - 1))", ("125e-2", "95e-2", "9e-1"), []),
    "snow": ("15e-2", "(235 + 6 * (2 * h - 1))", ("11e-1", "1e0", "9e-1"), []),
    "stale_map": ("5e-1", "(90 + 40 * (2 * h - 1))", ("1e0", "1e0", "9e-1"), [(_box(60, 10, 20, "125e-1"), "210e0"), (_box(0, 0, 15, 10), "200e0")]),
    "symmetric": ("4e-1", "(80 + 20 * (2 * h - 1))", ("1e0", "1e0", "1e0"), [(" OR ".join(f"abs(e - ({x})) < 6 OR abs(n - ({y})) < 6" for x, y in ((0, 0), (60, 0), (-60, 0), (0, 60), (0, -60))), "138e0")]),
}
for kind, (freq, ground, tints, shapes) in SECOND_VIEWS.items():
    over = lambda v, shapes=shapes: ("CASE " + " ".join(f"WHEN {c} THEN {w}" for c, w in shapes) + f" ELSE {v} END") if shapes else v
    figures = ", ".join(f"{over(_clip(f'{ground} * {t}'))} AS {c}" for c, t in zip("rgb", tints, strict=True))
    add(f"g12_texture_{kind}", "points", lambda p, kind=kind: p.select("id", im.texture(kind, *_en(), seed=3, second=True).alias("t")).select("id", "t.*"), "WITH " + SEEDED.format(f=freq) + f" SELECT id, {figures} FROM h3 JOIN p USING (id)", "r, g, b", "id", 6)
add("f70_tukey", "points", lambda p: p.select("id", im.tukey_weight(F.col("alt") / 1000, 4.0).alias("w"), im.tukey_rho(F.col("alt") / 1000, 4.0).alias("rho")), "SELECT id, CASE WHEN abs(alt) >= 4000 THEN 0 ELSE pow(1 - pow(alt / 4000, 2), 2) END AS w, CASE WHEN abs(alt) >= 4000 THEN 1 ELSE 1 - pow(1 - pow(alt / 4000, 2), 3) END AS rho FROM points", "w, rho", "id")
add("f71_hann", "points", lambda p: p.select("id", im.hann(F.col("id") % 64, 64).alias("h")), "SELECT id, 5e-1 * (1 - cos(2 * pi() * (id % 64) / 63)) AS h FROM points", "h", "id")
