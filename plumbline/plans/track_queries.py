"""Queries over tracks: ordered analytics and as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import chi_square, rotation
from ..operators import metrics as m
from ..operators import ordered as o
from ..operators import outages
from .tools import add

RUN = "OVER (PARTITION BY run_id ORDER BY ord)"


def _sides(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of one kind, and those of another to interpolate from, by event order as time."""
    t = t.withColumn("time", F.col("ord").cast("double"))
    return t.filter("event_type = 'click'").select("run_id", "ord", "time"), t.filter("event_type = 'purchase'").select("run_id", "time", "value", "path_m")


SIDES = "l AS (SELECT run_id, ord, CAST(ord AS DOUBLE) AS time FROM track WHERE event_type = 'click'), r AS (SELECT run_id, CAST(ord AS DOUBLE) AS time, value, path_m FROM track WHERE event_type = 'purchase')"
BOTH = f"""WITH {SIDES}, p AS (SELECT l.run_id, l.ord, l.time, r.time AS pt, r.value AS pv, r.path_m AS pp FROM l ASOF LEFT JOIN r ON l.run_id = r.run_id AND l.time >= r.time),
 n AS (SELECT l.run_id, l.ord, r.time AS nt, r.value AS nv, r.path_m AS np FROM l ASOF LEFT JOIN r ON l.run_id = r.run_id AND l.time <= r.time), b AS (SELECT p.*, nt, nv, np FROM p JOIN n ON p.ord = n.ord) """

add("w01_convergence_distance", "track", lambda t: t.groupBy("run_id").agg(o.first_where("path_m", F.col("value") < 20).alias("path_m")), "SELECT run_id, arg_min(path_m, ord) FILTER (WHERE value < 20) AS path_m FROM track GROUP BY run_id", "path_m", "run_id", 4)
add("w02_time_to_first_fix", "track", o.time_to_first, "SELECT run_id, arg_min(t_s, ord) FILTER (WHERE accepted) - arg_min(t_s, ord) AS ttff_s FROM track GROUP BY run_id", "ttff_s", "run_id")
add("w03_max_gap", "track", o.max_gap, f"SELECT run_id, max(g) AS max_gap FROM (SELECT run_id, path_m - lag(path_m) {RUN} AS g FROM track WHERE accepted) GROUP BY run_id", "max_gap", "run_id", 4)
add("w04_velocity_integral", "track", lambda t: o.integrate(t, "v_east", "i_east").select("ord", "i_east"), f"SELECT ord, sum(a) {RUN} AS i_east FROM (SELECT run_id, ord, coalesce((t_s - lag(t_s) {RUN}) * (v_east + lag(v_east) {RUN}) / 2, 0) AS a FROM track)", "i_east", "ord", 3)
add("w05_running_path", "track", lambda t: o.running_path(t.withColumns({"x": F.col("v_east"), "y": F.col("v_north")}).drop("path_m"), "x", "y").select("ord", "path_m"), f"SELECT ord, sum(s) {RUN} AS path_m FROM (SELECT run_id, ord, coalesce(sqrt(pow(v_east - lag(v_east) {RUN}, 2) + pow(v_north - lag(v_north) {RUN}, 2)), 0) AS s FROM track)", "path_m", "ord", 4)
add("w06_ecdf", "track", lambda t: o.ecdf(t, "value", ["run_id"], "ord").select("ord", "cdf"), "SELECT ord, row_number() OVER (PARTITION BY run_id ORDER BY value, ord) / CAST(count(*) OVER (PARTITION BY run_id) AS DOUBLE) AS cdf FROM track", "cdf", "ord")
add("w08_sliding_windows", "track", lambda t: o.sliding_windows(t, "t_s", 12.0, 4.0).groupBy("run_id", "window").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).filter("n >= 2"), "SELECT run_id, k AS \"window\", count(*) AS n, avg(value) AS mean FROM track, unnest(range(CAST(greatest(0, floor((t_s - 12) / 4) + 1) AS BIGINT), CAST(floor(t_s / 4) AS BIGINT) + 1)) AS x(k) GROUP BY run_id, k HAVING count(*) >= 2", "mean", "run_id, \"window\", n")


def _ratio(t: DataFrame) -> DataFrame:
    t = t.withColumns({"t_s": F.col("ord").cast("double"), "east": F.col("path_m"), "north": F.col("value")})
    return o.baseline_ratio(t, 300.0, 5.0)


RATIO = f"""WITH x AS (SELECT run_id, ord, CAST(ord AS DOUBLE) AS t, path_m AS east, value AS north, v_east, v_north, row_number() {RUN} AS n, CAST(ord AS DOUBLE) - lag(CAST(ord AS DOUBLE)) {RUN} AS dt FROM track),
 y AS (SELECT *, coalesce(dt * (v_east + lag(v_east) {RUN}) / 2, 0) AS ae, coalesce(dt * (v_north + lag(v_north) {RUN}) / 2, 0) AS an FROM x),
 z AS (SELECT *, sum(ae) {RUN} AS ie, sum(an) {RUN} AS i_n FROM y), s AS (SELECT run_id, greatest(1, CAST(round_even(300 / quantile_cont(dt, 0.5), 0) AS INT)) AS step FROM x GROUP BY run_id),
 p AS (SELECT a.run_id, sqrt(pow(b.east - a.east, 2) + pow(b.north - a.north, 2)) AS dp, sqrt(pow(b.ie - a.ie, 2) + pow(b.i_n - a.i_n, 2)) AS di FROM z a JOIN s ON a.run_id = s.run_id JOIN z b ON b.run_id = a.run_id AND b.n = a.n + s.step)
 SELECT run_id, median(dp / di) AS ratio, min(dp / di) AS ratio_min, max(dp / di) AS ratio_max, count(*) AS n FROM p WHERE di >= 5 GROUP BY run_id"""
add("a36_velocity_ratio", "track", _ratio, RATIO, "ratio, ratio_min, ratio_max", "run_id, n", 5)
add("j14_baseline_step", "track", lambda t: o.moved_over(t, "path_m", 5).select("ord", "moved"), f"SELECT ord, lead(path_m, 5) {RUN} - path_m AS moved FROM track", "moved", "ord", 4)
add("j01_as_of_neighbours", "track", lambda t: o.as_of(*_sides(t), ["value"], time="time").select("ord", "prev_time", "prev_value", "next_time", "next_value"), BOTH + "SELECT ord, pt AS prev_time, pv AS prev_value, nt AS next_time, nv AS next_value FROM b", "prev_time, prev_value, next_time, next_value", "ord")
INTERP = "CASE WHEN pt IS NULL THEN nv WHEN nt IS NULL OR nt = pt THEN pv {gap} ELSE pv * (1 - (time - pt) / (nt - pt)) + nv * ((time - pt) / (nt - pt)) END"
add("j02_interpolate_track", "track", lambda t: o.interpolate(*_sides(t), ["value"], time="time").select("ord", "value"), BOTH + f"SELECT ord, {INTERP.format(gap='')} AS value FROM b", "value", "ord")
add("j01_interpolate_with_gap", "track", lambda t: o.interpolate(*_sides(t), ["value"], time="time", max_gap=400.0).select("ord", "value"), BOTH + f"SELECT ord, {INTERP.format(gap='WHEN nt - pt > 400 THEN pv')} AS value FROM b", "value", "ord")


def _pose_at(t: DataFrame) -> DataFrame:
    """Rotation half-way between the neighbours of each click, by slerp."""
    found = o.as_of(*_sides(t), ["value"], time="time").filter("prev_time IS NOT NULL AND next_time IS NOT NULL")
    z, zero = lambda v: F.col(v) / 500, F.lit(0.0)
    q = lambda v: rotation.quaternion(F.cos(z(v) / 2), zero, zero, F.sin(z(v) / 2))
    return found.withColumn("q", rotation.slerp(q("prev_value"), q("next_value"), F.lit(0.5))).select("ord", F.col("q.w").alias("w"), F.col("q.z").alias("z"))


add("j03_slerp_pose", "track", _pose_at, BOTH + "SELECT ord, cos((pv + nv) / 2000) AS w, sin((pv + nv) / 2000) AS z FROM b WHERE pt IS NOT NULL AND nt IS NOT NULL", "w, z", "ord", 5)


def _walked(t: DataFrame) -> DataFrame:
    """Paths to the micrometre, where a limit cuts them: doubles whose sum is 2,000.00 m may add up to a little less."""
    return t.withColumn("path_m", F.round("path_m", 6))


add("a09_early_fixes", "track", lambda t: m.early_fixes(_walked(t)), "SELECT run_id, count(*) FILTER (WHERE accepted AND path_m < 2000) AS n FROM track GROUP BY run_id")
add(
    "a12_w07_innovations", "fixes", lambda f: o.innovations(f).groupBy("run_id").agg(F.avg(F.abs("innov_east")).alias("mean"), F.count("innov_east").alias("n")),
    "SELECT run_id, avg(abs(i)) AS mean, count(i) AS n FROM (SELECT run_id, est_east - (lag(est_east) OVER w + (lag(est_east) OVER w - lag(est_east, 2) OVER w) * (t_s - lag(t_s) OVER w) / nullif(lag(t_s) OVER w - lag(t_s, 2) OVER w, 0)) AS i FROM fixes WHERE accepted WINDOW w AS (PARTITION BY run_id ORDER BY ord)) GROUP BY run_id", "mean", "run_id, n", 4,
)
add(
    "a16_trajectory_table", "fixes", lambda f: m.trajectory_level(f.withColumn("path_m", F.col("t_s") * 2), converged_deg=8.0),
    """WITH e AS (SELECT *, est_east - gt_east AS de, est_north - gt_north AS dn, t_s * 2 AS path_m, degrees(sqrt(greatest(cov_yy, 0))) AS s FROM fixes),
 g AS (SELECT *, path_m - lag(path_m) OVER (PARTITION BY run_id ORDER BY ord) AS gap FROM e)
 SELECT run_id, sqrt(avg(de * de + dn * dn)) AS ate_rmse, quantile_cont(abs(dn * cos(gt_yaw) - de * sin(gt_yaw)), 0.95) AS lateral_p95,
 quantile_cont(abs(degrees(atan2(sin(est_yaw - gt_yaw), cos(est_yaw - gt_yaw)))), 0.95) AS yaw_p95, arg_min(path_m, ord) FILTER (WHERE s < 8) AS convergence_m, max(gap) AS max_gap_m FROM g GROUP BY run_id""",
    "ate_rmse, lateral_p95, yaw_p95, convergence_m, max_gap_m", "run_id", 5,
)
add(
    "a12_nis", "fixes", lambda f: m.innovation_consistency(o.innovations(f)).groupBy("run_id").agg(F.avg("nis").alias("nis"), F.count("nis").alias("n")),
    """WITH a AS (SELECT *, lag(est_east) OVER w AS e1, lag(est_east, 2) OVER w AS e2, lag(est_north) OVER w AS n1, lag(est_north, 2) OVER w AS n2, lag(t_s) OVER w AS t1, lag(t_s, 2) OVER w AS t2,
 cov_ee + lag(cov_ee) OVER w AS ee, cov_en + lag(cov_en) OVER w AS en, cov_nn + lag(cov_nn) OVER w AS nn FROM fixes WHERE accepted WINDOW w AS (PARTITION BY run_id ORDER BY ord)),
 i AS (SELECT *, est_east - (e1 + (e1 - e2) * (t_s - t1) / nullif(t1 - t2, 0)) AS de, est_north - (n1 + (n1 - n2) * (t_s - t1) / nullif(t1 - t2, 0)) AS dn FROM a),
 q AS (SELECT run_id, (nn * de * de - 2 * en * de * dn + ee * dn * dn) / nullif(ee * nn - en * en, 0) AS nis FROM i) SELECT run_id, avg(nis) AS nis, count(nis) AS n FROM q GROUP BY run_id""",
    "nis", "run_id, n", 2,
)
add("t01_request_rate", "track", lambda t: o.request_rate(t).select("ord", "um_per_s"), f"SELECT ord, (path_cm - lag(path_cm) {RUN}) * 10000 // (ord - lag(ord) {RUN}) AS um_per_s FROM track")
add("t03_look_ahead", "track", lambda t: o.look_ahead(_walked(t).withColumns({"east": F.col("path_m"), "north": F.col("value")}), 2.0, 50.0).select("ord", "tile_e", "tile_n"), "SELECT ord, CAST(floor((path_m + v_east * 2) / 50) AS BIGINT) AS tile_e, CAST(floor((value + v_north * 2) / 50) AS BIGINT) AS tile_n FROM track")
_span = lambda: W.partitionBy("run_id").orderBy("ord")
add("x08_mode_fraction", "track", lambda t: t.withColumn("dt", F.lead("ord").over(_span()) - F.col("ord")).groupBy("run_id").agg(F.try_divide(F.sum(F.when(F.col("accepted"), F.col("dt")).otherwise(0)), F.sum("dt")).alias("share")), f"SELECT run_id, sum(CASE WHEN accepted THEN dt ELSE 0 END) / CAST(sum(dt) AS DOUBLE) AS share FROM (SELECT run_id, accepted, lead(ord) {RUN} - ord AS dt FROM track) GROUP BY run_id", "share", "run_id")
add("x03_consistency_window", "track", lambda t: t.withColumn("spread", F.max("value").over(_span().rowsBetween(-4, 0)) - F.min("value").over(_span().rowsBetween(-4, 0))).groupBy("run_id").agg(F.count_if(F.col("spread") <= 25).alias("n")), "SELECT run_id, count(*) FILTER (WHERE s <= 25) AS n FROM (SELECT run_id, max(value) OVER w - min(value) OVER w AS s FROM track WINDOW w AS (PARTITION BY run_id ORDER BY ord ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) GROUP BY run_id")

_timed = lambda t: t.filter("value <= 40").select("run_id", F.timestamp_seconds("ord").alias("ts"), (F.col("path_cm") / 100.0).alias("path_m"), (F.col("value") <= 20).alias("nominal"))
add("x08_recovery_time", "track", lambda t: outages.recoveries(outages.sessions(_timed(t), 250.5), 50.0).select("run_id", F.unix_seconds("begun").alias("begun_s"), "outage_m", "recovery_s"), """WITH f AS (SELECT run_id, ord, path_cm / 1e2 AS path_m, value <= 20 AS nominal, ord - lag(ord) OVER (PARTITION BY run_id ORDER BY ord) AS gap FROM track WHERE value <= 40),
 s AS (SELECT *, sum(CASE WHEN gap > 250 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY ord) AS span FROM f),
 a AS (SELECT run_id, min(ord) AS begun, min(ord) FILTER (WHERE nominal) AS nominal_at, min(path_m) AS path_from, max(path_m) AS path_to FROM s GROUP BY run_id, span),
 b AS (SELECT *, path_from - lag(path_to) OVER (PARTITION BY run_id ORDER BY begun) AS outage_m FROM a)
 SELECT run_id, begun AS begun_s, outage_m, CAST(nominal_at - begun AS DOUBLE) AS recovery_s FROM b WHERE outage_m >= 50""", "outage_m, recovery_s", "run_id, begun_s")
add("x08_fixes_per_km", "track", lambda t: outages.fixes_per_km(t.withColumn("path_m", F.col("path_cm") / 100.0)), "SELECT run_id, count(*) FILTER (WHERE accepted) * 1e3 / nullif(max(path_cm / 1e2) - min(path_cm / 1e2), 0) AS fixes_per_km FROM track GROUP BY run_id", "fixes_per_km", "run_id")
add("x08_covariance_growth", "fixes", lambda f: outages.growing_covariance(f.withColumns({"coasting": ~F.col("accepted"), "sigma": F.col("cov_yy")})), "SELECT run_id, count(*) FILTER (WHERE c AND pc AND s < ps) AS falls, count(*) FILTER (WHERE c AND pc AND s < ps) = 0 AS monotone FROM (SELECT run_id, NOT accepted AS c, lag(NOT accepted) OVER w AS pc, cov_yy AS s, lag(cov_yy) OVER w AS ps FROM fixes WINDOW w AS (PARTITION BY run_id ORDER BY ord, cov_yy, NOT accepted)) q GROUP BY run_id")


def _consistency(f: DataFrame) -> DataFrame:
    blocks = m.nees(f).groupBy("run_id", F.floor(F.col("t_s") / 500).alias("block")).agg(F.sum("nees").alias("total"), (2 * F.count("nees")).alias("dof"))
    return chi_square.consistent(blocks, "total", "dof").select("run_id", "block", "dof", "total", "lower", "upper", "inside")


add("x06_nees_interval", "fixes", _consistency, """WITH RECURSIVE e AS (SELECT *, est_east - gt_east AS de, est_north - gt_north AS dn FROM fixes),
 b AS (SELECT run_id, CAST(floor(t_s / 500) AS BIGINT) AS block, sum((cov_nn * de * de - 2 * cov_en * de * dn + cov_ee * dn * dn) / (cov_ee * cov_nn - cov_en * cov_en)) AS total, 2 * count(*) AS dof FROM e GROUP BY 1, 2),
 q AS (SELECT dof, p, 0e0 AS lo, dof * 4e0 + 40 AS hi, 0 AS i FROM (SELECT DISTINCT dof FROM b) d, unnest([25e-3, 975e-3]) AS x(p)
  UNION ALL SELECT dof, p, CASE WHEN c < p THEN x ELSE lo END, CASE WHEN c < p THEN hi ELSE x END, i + 1 FROM
   (SELECT *, (lo + hi) / 2 AS x, list_sum(list_transform(range(0, CAST(hi + 200 AS BIGINT)), lambda n: exp((dof / 2e0 + n) * ln((lo + hi) / 4) - (lo + hi) / 4 - lgamma(dof / 2e0 + n + 1)))) AS c FROM q WHERE i < 60) z),
 l AS (SELECT dof, max(lo) FILTER (WHERE p < 5e-1) AS lower, max(lo) FILTER (WHERE p > 5e-1) AS upper FROM q WHERE i = 60 GROUP BY dof)
 SELECT run_id, block, b.dof, total, lower, upper, total BETWEEN lower AND upper AS inside FROM b JOIN l ON l.dof = b.dof""", "total, lower, upper", "run_id, block, dof, inside", 5)
