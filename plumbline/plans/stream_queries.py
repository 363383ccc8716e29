"""Batch twins of the stateful streams, over the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import stateful as s
from ..streaming import timers
from . import register
from .tools import add, rounded

_rows = lambda t: t.select("run_id", "ord", F.col("ord").cast("double").alias("t"), "value")

NUMBERED = "RECURSIVE q AS (SELECT run_id, ord, value AS v, row_number() OVER (PARTITION BY run_id ORDER BY ord) AS k FROM track)"
add("x03_consistency_gate", "track", lambda t: s.batch_twin(_rows(t), s.consistency_step(), "accepted boolean, run int"), f"""WITH {NUMBERED},
 f AS (SELECT run_id, ord, k, v AS last, CAST(0 AS INT) AS held, 0e0 AS lo, 0e0 AS hi, true AS accepted, CAST(0 AS INT) AS run FROM q WHERE k = 1
  UNION ALL SELECT q.run_id, q.ord, q.k, CASE WHEN near OR r2 >= 5 THEN q.v ELSE f.last END, CAST(CASE WHEN near OR r2 >= 5 THEN 0 ELSE r2 END AS INT), CASE WHEN near OR r2 >= 5 THEN 0e0 ELSE l2 END, CASE WHEN near OR r2 >= 5 THEN 0e0 ELSE h2 END, near OR r2 >= 5, CAST(CASE WHEN near THEN 0 ELSE r2 END AS INT)
  FROM f JOIN q ON q.run_id = f.run_id AND q.k = f.k + 1, LATERAL (SELECT abs(q.v - f.last) <= 25 AS near, CASE WHEN f.held > 0 THEN least(f.lo, q.v) ELSE q.v END AS l1, CASE WHEN f.held > 0 THEN greatest(f.hi, q.v) ELSE q.v END AS h1) a,
  LATERAL (SELECT CASE WHEN h1 - l1 > 25 THEN q.v ELSE l1 END AS l2, CASE WHEN h1 - l1 > 25 THEN q.v ELSE h1 END AS h2, CASE WHEN h1 - l1 > 25 THEN 1 ELSE f.held + 1 END AS r2) b) SELECT run_id, ord, accepted, run FROM f""")
add("x07_operating_modes", "track", lambda t: s.batch_twin(_rows(t), s.mode_step(), "mode string, quiet_s double"), f"""WITH {NUMBERED},
 f AS (SELECT run_id, ord, k, CASE WHEN v <= 20 THEN 'nominal' ELSE 'init' END AS mode, CASE WHEN v <= 20 THEN CAST(ord AS DOUBLE) END AS since, 0e0 AS quiet_s FROM q WHERE k = 1
  UNION ALL SELECT q.run_id, q.ord, q.k, CASE WHEN q.v <= 20 THEN CASE WHEN f.mode IN ('coasting', 'lost') THEN 'recovery' ELSE 'nominal' END WHEN z.quiet > 180 THEN 'lost' WHEN z.quiet > 20 THEN 'coasting' WHEN f.mode = 'nominal' AND q.v > 25 THEN 'degraded' WHEN f.mode = 'recovery' THEN 'degraded' ELSE f.mode END,
  CASE WHEN q.v <= 20 THEN CAST(q.ord AS DOUBLE) ELSE f.since END, z.quiet FROM f JOIN q ON q.run_id = f.run_id AND q.k = f.k + 1, LATERAL (SELECT coalesce(q.ord - f.since, 0e0) AS quiet) z) SELECT run_id, ord, mode, quiet_s FROM f""")
add("t02_centre_cache", "track", lambda t: s.batch_twin(_rows(t), s.cache_step(20.0), "hit boolean, misses int"), f"""WITH {NUMBERED},
 f AS (SELECT run_id, ord, k, v AS centre, false AS hit, CAST(1 AS INT) AS misses FROM q WHERE k = 1
  UNION ALL SELECT q.run_id, q.ord, q.k, CASE WHEN ok THEN f.centre ELSE q.v END, ok, CAST(f.misses + CASE WHEN ok THEN 0 ELSE 1 END AS INT)
  FROM f JOIN q ON q.run_id = f.run_id AND q.k = f.k + 1, LATERAL (SELECT abs(q.v - f.centre) <= 3e-1 * 2 * 2e1 AS ok) z) SELECT run_id, ord, hit, misses FROM f""")
_asked = lambda t: t.select("run_id", "ord", F.col("path_cm").cast("double").alias("east"), F.col("value").alias("north"), F.lit(2000.0).alias("radius_m"), F.pmod(F.floor(F.col("ord") / 400), F.lit(2)).cast("double").alias("gsd"), F.lit("m1").alias("model"))
add("t02_descriptor_cache", "track", lambda t: s.batch_twin(_asked(t), s.descriptor_step(), "hit boolean, misses int"), """WITH RECURSIVE q AS (SELECT run_id, ord, CAST(path_cm AS DOUBLE) AS e, value AS n, CAST((ord // 400) % 2 AS DOUBLE) AS g, row_number() OVER (PARTITION BY run_id ORDER BY ord) AS k FROM track),
 f AS (SELECT run_id, ord, k, e, n, g, false AS hit, CAST(1 AS INT) AS misses FROM q WHERE k = 1
  UNION ALL SELECT q.run_id, q.ord, q.k, CASE WHEN ok THEN f.e ELSE q.e END, CASE WHEN ok THEN f.n ELSE q.n END, CASE WHEN ok THEN f.g ELSE q.g END, ok, CAST(f.misses + CASE WHEN ok THEN 0 ELSE 1 END AS INT)
  FROM f JOIN q ON q.run_id = f.run_id AND q.k = f.k + 1, LATERAL (SELECT sqrt(pow(q.e - f.e, 2) + pow(q.n - f.n, 2)) <= 1200 AND q.g = f.g AS ok) z) SELECT run_id, ord, hit, misses FROM f""")

_requests = lambda t: t.select("run_id", "ord", F.col("ord").cast("double").alias("t"), (F.col("path_cm") / 100.0).alias("east"), F.col("value").alias("north"))
add("t03_prefetch_ticks", "track", lambda t: timers.prefetch_ticks(_requests(t), 40.0, 2.9495762407505253, 1000.0), """WITH q AS (SELECT run_id, CAST(ord AS DOUBLE) AS t, path_cm / 1e2 AS e, value AS n, lag(CAST(ord AS DOUBLE)) OVER w AS pt, lag(path_cm / 1e2) OVER w AS pe, lag(value) OVER w AS pn, lead(CAST(ord AS DOUBLE)) OVER w AS nt FROM track WINDOW w AS (PARTITION BY run_id ORDER BY ord)),
 v AS (SELECT *, coalesce((e - pe) / (t - pt), 0e0) AS ve, coalesce((n - pn) / (t - pt), 0e0) AS vn FROM q),
 k AS (SELECT *, unnest(range(CAST(ceil(t / 40) AS BIGINT), CAST(least(ceil(coalesce(nt, 1e18) / 40) - 1, floor((t + 1000) / 40)) AS BIGINT) + 1)) AS k FROM v WHERE sqrt(ve * ve + vn * vn) >= 1e-3)
 SELECT run_id, k * 4e1 AS tick_s, e + ve * 29495762407505253e-16 AS east, n + vn * 29495762407505253e-16 AS north, 2 * 29495762407505253e-16 * sqrt(ve * ve + vn * vn) AS radius_m FROM k""", "tick_s, east, north, radius_m", "run_id")


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = s.windowed_rates(spark.read.parquet(f"{sf_dir}/events.parquet"), "1 day")
    return rounded(made.withColumn("start", F.date_format("start", "yyyy-MM-dd")), 8)


register("x09_windowed_rates", _rates, "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, event_type, count(*) AS n, round(avg(value), 8) + 0e0 AS mean, round(max(value), 8) + 0e0 AS top FROM events GROUP BY 1, 2")
