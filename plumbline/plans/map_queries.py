"""Queries over map windows, tile stores, layers and alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align, maps
from ..sources import records
from . import register
from .tools import add, rounded

add("p10_point_in_quad", "points", lambda p: p.select("id", maps.in_quad(F.col("lon_deg"), F.col("lat_deg"), [(F.lit(a), F.lit(b)) for a, b in ((37.0, 41.0), (41.0, 42.0), (40.0, 48.0), (37.5, 46.0))]).alias("inside")), "SELECT id, ((41 - 37e0) * (lat_deg - 41) - (42 - 41e0) * (lon_deg - 37) >= 0 AND (40 - 41e0) * (lat_deg - 42) - (48 - 42e0) * (lon_deg - 41) >= 0 AND (375e-1 - 40) * (lat_deg - 48) - (46 - 48e0) * (lon_deg - 40) >= 0 AND (37 - 375e-1) * (lat_deg - 46) - (41 - 46e0) * (lon_deg - 375e-1) >= 0) AS inside FROM points")
_centres = lambda c: c.select((F.col("r") * 128 + F.col("c")).alias("id"), (F.col("c") + 0.5).alias("x"), (F.col("r") + 0.5).alias("y"))
add("j06_map_windows", "classes", lambda c: maps.extract_window(_centres(c), c.withColumn("v", F.col("class").cast("double")), 2), "WITH k AS (SELECT r * 128 + c AS id, r, c FROM classes) SELECT id, CAST(a.dr AS INT) AS dr, CAST(b.dc AS INT) AS dc, coalesce(CAST(x.class AS DOUBLE), 0e0) AS v FROM k CROSS JOIN (SELECT unnest(range(-2, 3)) AS dr) a CROSS JOIN (SELECT unnest(range(-2, 3)) AS dc) b LEFT JOIN classes x ON x.r = k.r + dr AND x.c = k.c + dc", "v", "id, dr, dc")
add("w11_sample_density", "pixels", lambda p: maps.sample_density(p.withColumns({"u": F.col("c") * 1.5 + F.col("v").cast("double"), "w": F.col("r") * 2.0 + F.col("v").cast("double") * 0.5}), "u", "w").select("image", "r", "c", "density"), """WITH q AS (SELECT image, r, c, c * 15e-1 + CAST(v AS DOUBLE) AS u, r * 2e0 + CAST(v AS DOUBLE) * 5e-1 AS w FROM pixels), d AS (SELECT image, r, c,
 CASE WHEN lag(u) OVER x IS NULL THEN lead(u) OVER x - u WHEN lead(u) OVER x IS NULL THEN u - lag(u) OVER x ELSE (lead(u) OVER x - lag(u) OVER x) / 2 END AS ux, CASE WHEN lag(w) OVER x IS NULL THEN lead(w) OVER x - w WHEN lead(w) OVER x IS NULL THEN w - lag(w) OVER x ELSE (lead(w) OVER x - lag(w) OVER x) / 2 END AS wx,
 CASE WHEN lag(u) OVER y IS NULL THEN lead(u) OVER y - u WHEN lead(u) OVER y IS NULL THEN u - lag(u) OVER y ELSE (lead(u) OVER y - lag(u) OVER y) / 2 END AS uy, CASE WHEN lag(w) OVER y IS NULL THEN lead(w) OVER y - w WHEN lead(w) OVER y IS NULL THEN w - lag(w) OVER y ELSE (lead(w) OVER y - lag(w) OVER y) / 2 END AS wy
 FROM q WINDOW x AS (PARTITION BY image, r ORDER BY c), y AS (PARTITION BY image, c ORDER BY r)) SELECT image, r, c, abs(ux * wy - uy * wx) AS density FROM d""", "density", "image, r, c", 4)


def _shifted(p: DataFrame, c: DataFrame, shift=maps.orthometric_to_ellipsoidal) -> DataFrame:
    """Heights by the nearest cell of the whole raster, whose extent comes from the data."""
    nodes = c.select(F.col("c").alias("i"), F.col("r").alias("j"), F.col("class").alias("v"))
    top = nodes.agg(F.max("i") + 1, F.max("j") + 1).first()
    size = (top[0] or 1, top[1] or 1)
    return maps.nearest_cell(p.select("id", "alt", F.col("lon_deg").alias("x"), F.col("lat_deg").alias("y")), nodes, (36.0, 40.0), 0.2, size).select("id", shift(F.col("alt"), F.col("v")).alias("h"))


SHIFT = """WITH e AS (SELECT max(c) AS cm, max(r) AS rm FROM classes) SELECT p.id, alt {sign} class AS h FROM (SELECT id, alt, CAST(greatest(0, least(cm, round_even((lon_deg - 36) / 2e-1, 0))) AS BIGINT) AS i, CAST(greatest(0, least(rm, round_even((lat_deg - 40) / 2e-1, 0))) AS BIGINT) AS j FROM points, e) p LEFT JOIN classes k ON k.c = p.i AND k.r = p.j"""
add("s53_f16_datum_shift", "points classes", _shifted, SHIFT.format(sign="+"), "h", "id")
add("f17_orthometric", "points classes", lambda p, c: _shifted(p, c, maps.ellipsoidal_to_orthometric), SHIFT.format(sign="-"), "h", "id")
add("k04_control_points", "points", lambda p: maps.every_kth(p.select("id"), ["id"], 40), "SELECT id FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k, count(*) OVER () AS n FROM points) WHERE k % CAST(greatest(1, ceil(n / 40e0)) AS BIGINT) = 0 ORDER BY id LIMIT 40")
add("k06_finest_zoom", "points", lambda p: maps.finest_usable(p.select("z", (F.col("alt") > F.col("z") * 300 - 1000).alias("ok")), 0.7), "SELECT coalesce(max(CASE WHEN s >= 7e-1 THEN z END), min(z)) AS z FROM (SELECT z, avg(CASE WHEN alt > z * 300 - 1000 THEN 1e0 ELSE 0e0 END) AS s FROM points GROUP BY z)")


def _seams(p: DataFrame) -> DataFrame:
    return maps.edge_cells(p.select(F.col("id").alias("line"), (F.col("lon_deg") * 10).alias("x1"), (F.col("lat_deg") * 10).alias("y1"), (F.col("lon_deg") * 10 + 7.5).alias("x2"), (F.col("lat_deg") * 10 - 4).alias("y2"))).groupBy("line").agg(F.count("*").alias("cells"))


add("r08_seam_cells", "points", _seams, "WITH e AS (SELECT id AS line, lon_deg * 10 AS x1, lat_deg * 10 AS y1, lon_deg * 10 + 75e-1 AS x2, lat_deg * 10 - 4 AS y2 FROM points), n AS (SELECT *, greatest(1, ceil(greatest(abs(x2 - x1), abs(y2 - y1)))) AS n FROM e), k AS (SELECT line, x1, y1, x2, y2, n, unnest(range(CAST(n AS BIGINT) + 1)) AS k FROM n) SELECT line, count(*) AS cells FROM (SELECT DISTINCT line, floor(y1 + k / n * (y2 - y1)) + dr, floor(x1 + k / n * (x2 - x1)) + dc FROM k, unnest([-1, 0, 1]) AS a(dr), unnest([-1, 0, 1]) AS b(dc)) GROUP BY line")


def _tables(name: str, tables: str, query, sql: str, digits: int = 6) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(query(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables.split())), digits)

    register(name, run, sql)


_tables("s35_missing_requests", "orders customer", lambda o, c: maps.missing(o.select("o_orderkey", F.col("o_custkey").alias("k")), c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k")), ["k"]).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
_tables("s36_cached_requests", "orders customer", lambda o, c: maps.cached(o.select("o_orderkey", F.col("o_custkey").alias("k")), c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k")), ["k"]).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
_tables("s37_latest_metadata", "events", lambda e: records.latest(e.select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id"), "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, round(arg_max(value, event_id), 6) + 0e0 AS value FROM events GROUP BY user_id")
_tables("s41_priority_fallback", "supplier", lambda s: records.by_priority(s.select("s_nationkey", "s_suppkey", "s_name"), ["s_nationkey"], "s_suppkey"), "SELECT s_nationkey, min(s_suppkey) AS s_suppkey, arg_min(s_name, s_suppkey) AS s_name FROM supplier GROUP BY s_nationkey")
_tables("s04_stems", "pages", lambda p: p.select("page_id", records.stem(F.concat("url", F.when(F.col("page_id") % 3 == 0, ".fixes.csv").when(F.col("page_id") % 3 == 1, ".trajectory.csv").otherwise(".csv"))).alias("stem")), "SELECT page_id, url AS stem FROM pages")
_tables("j15_layer_problems", "customer", lambda c: maps.layer_problems(c.select(F.col("c_custkey").alias("layer"), F.when(F.col("c_custkey") % 7 == 0, "EPSG:32636").otherwise("EPSG:32637").alias("crs"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")).alias("license")), "EPSG:32637", ("license",)), "SELECT c_custkey AS layer, 'crs' AS problem FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT c_custkey, 'no license' FROM customer WHERE c_custkey % 5 = 0")
_tables("s09_json_summary", "orders", lambda o: o.groupBy("o_orderstatus").agg(F.count("*").alias("n")).select("o_orderstatus", F.get_json_object(F.to_json(F.struct("n", "o_orderstatus")), "$.n").cast("long").alias("n")), "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
_tables("u04_required_keys", "events", lambda e: e.select("event_id", F.size(F.array_except(F.array(F.lit("k"), F.lit("z")), F.map_keys(F.from_json("props", "map<string,string>")))).alias("missing")), "SELECT event_id, CAST(2 - (CASE WHEN json_exists(props, '$.k') THEN 1 ELSE 0 END) - (CASE WHEN json_exists(props, '$.z') THEN 1 ELSE 0 END) AS INT) AS missing FROM events")
_tables("x14_trends", "orders", lambda o: o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.avg("o_totalprice").alias("mean"), F.percentile("o_totalprice", F.lit(0.95)).alias("p95")), "SELECT strftime(o_orderdate, '%Y-%m') AS month, round(avg(o_totalprice), 7) + 0e0 AS mean, round(quantile_cont(o_totalprice, 0.95), 7) + 0e0 AS p95 FROM orders GROUP BY 1", 7)


def _runs(t: DataFrame) -> DataFrame:
    """Positions and a turned copy of them as odometry, a pair a row."""
    t = t.withColumns({"t_s": F.col("ord") / 1000, "bx": F.col("path_m"), "by": F.col("value")})
    return t.select("run_id", "t_s", (0.8 * F.col("bx") + 0.6 * F.col("by")).alias("ax"), (0.8 * F.col("by") - 0.6 * F.col("bx")).alias("ay"), "bx", "by")


add("n05_knot_alignment", "track", lambda t: align.knots(_runs(t), 2.0, rounds=5).select("run_id", "knot", "heading"), None, digits=3)
