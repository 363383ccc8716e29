"""Queries over position fixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import angles, covariance
from ..operators import metrics as m
from ..operators.quantiles import exact_quantiles
from .tools import add

ERR = """e AS (SELECT *, est_east - gt_east - {be} AS de, est_north - gt_north - {bn} AS dn, sqrt(pow(est_east - gt_east - {be}, 2) + pow(est_north - gt_north - {bn}, 2)) AS err,
 abs(degrees(atan2(sin(est_yaw - gt_yaw), cos(est_yaw - gt_yaw)))) AS yerr FROM {src})"""
AGG = """count(*) AS n_attempts, count(*) FILTER (WHERE accepted) AS n_accepted, count(*) FILTER (WHERE accepted) / CAST(count(*) AS DOUBLE) AS acceptance_rate,
 avg(CASE WHEN err <= 5 THEN 1e0 ELSE 0e0 END) FILTER (WHERE accepted) AS a_at_5, avg(CASE WHEN err <= 10 THEN 1e0 ELSE 0e0 END) FILTER (WHERE accepted) AS a_at_10,
 avg(CASE WHEN err <= 20 THEN 1e0 ELSE 0e0 END) FILTER (WHERE accepted) AS a_at_20, avg(CASE WHEN err <= 50 THEN 1e0 ELSE 0e0 END) FILTER (WHERE accepted) AS a_at_50,
 quantile_cont(yerr, 0.5) FILTER (WHERE accepted) AS re_med_deg, quantile_cont(yerr, 0.95) FILTER (WHERE accepted) AS re_p95_deg,
 avg(CASE WHEN err > 50 THEN 1e0 ELSE 0e0 END) FILTER (WHERE accepted) AS ifr, quantile_cont(latency_ms, 0.5) AS latency_p50_ms, quantile_cont(latency_ms, 0.95) AS latency_p95_ms"""
FIGURES = "acceptance_rate, a_at_5, a_at_10, a_at_20, a_at_50, re_med_deg, re_p95_deg, ifr, latency_p50_ms, latency_p95_ms"
TERRAIN = ", ".join(f"'{t}'" for t in m.TERRAIN)


def err(src: str = "fixes", be: float = 0.0, bn: float = 0.0) -> str:
    return ERR.format(src=src, be=f"{be:.1f}e0", bn=f"{bn:.1f}e0")


def errors(inner: str, src: str = "fixes") -> str:
    """``inner`` over the fixes with their errors."""
    return f"WITH {err(src)} {inner}"


add("a14_fix_level", "fixes", lambda f: m.fix_level(f, ("run_id",)), errors(f"SELECT run_id, {AGG} FROM e GROUP BY run_id"), FIGURES, "run_id, n_attempts, n_accepted")
add(
    "a23_fix_level_by_terrain", "fixes", m.fix_level_by_terrain,
    errors(f"SELECT CASE WHEN grouping(terrain) = 1 THEN 'all' ELSE terrain END AS terrain, {AGG} FROM e GROUP BY GROUPING SETS ((), (terrain)) HAVING grouping(terrain) = 1 OR terrain IN ({TERRAIN})"),
    FIGURES, "terrain, n_attempts, n_accepted",
)
add(
    "a22_dual_bias", "fixes", lambda f: m.dual_bias(f, (3.0, 4.0)),
    f"SELECT 'with' AS mode, {AGG} FROM (WITH {err()} SELECT * FROM e) GROUP BY 1 UNION ALL SELECT 'without' AS mode, {AGG} FROM (WITH {err(be=3.0, bn=4.0)} SELECT * FROM e) GROUP BY 1",
    FIGURES, "mode, n_attempts, n_accepted",
)
for d in (5, 10, 20, 50):
    add(f"a01_within_{d}m", "fixes", lambda f, d=d: m.with_errors(f).agg(m.within(float(d)).alias("share")), errors(f"SELECT avg(CASE WHEN err <= {d} THEN 1e0 ELSE 0e0 END) AS share FROM e WHERE accepted"), "share")
add("a02_integrity_failure_rate", "fixes", lambda f: m.with_errors(f).agg(m.beyond().alias("ifr")), errors("SELECT avg(CASE WHEN err > 50 THEN 1e0 ELSE 0e0 END) AS ifr FROM e WHERE accepted"), "ifr")
add("a03_acceptance_rate", "fixes", lambda f: f.groupBy("run_id").agg(F.try_divide(F.count_if("accepted"), F.count("*")).alias("rate")), "SELECT run_id, count(*) FILTER (WHERE accepted) / CAST(count(*) AS DOUBLE) AS rate FROM fixes GROUP BY run_id", "rate", "run_id")
add("a04_heading_error", "fixes", lambda f: exact_quantiles(m.with_errors(f), [], {"p50": (m.accepted("yaw_err_deg"), 0.5), "p95": (m.accepted("yaw_err_deg"), 0.95)}), errors("SELECT quantile_cont(yerr, 0.5) AS p50, quantile_cont(yerr, 0.95) AS p95 FROM e WHERE accepted"), "p50, p95")
add("a05_percentiles", "fixes", lambda f: exact_quantiles(f, [], {f"p{int(q * 100)}": (F.col("latency_ms"), q) for q in (0.05, 0.25, 0.75, 0.99)}), "SELECT quantile_cont(latency_ms, 0.05) AS p5, quantile_cont(latency_ms, 0.25) AS p25, quantile_cont(latency_ms, 0.75) AS p75, quantile_cont(latency_ms, 0.99) AS p99 FROM fixes", "p5, p25, p75, p99")
add("a06_latency", "fixes", lambda f: exact_quantiles(f, ["terrain"], {"p50": (F.col("latency_ms"), 0.5), "p95": (F.col("latency_ms"), 0.95)}), "SELECT terrain, quantile_cont(latency_ms, 0.5) AS p50, quantile_cont(latency_ms, 0.95) AS p95 FROM fixes GROUP BY terrain", "p50, p95", "terrain")
add("a07_rmse", "fixes", lambda f: m.with_errors(f).groupBy("run_id").agg(m.rmse().alias("rmse")), errors("SELECT run_id, sqrt(avg(err * err)) AS rmse FROM e GROUP BY run_id"), "rmse", "run_id")
add("a08_lateral_p95", "fixes", lambda f: exact_quantiles(m.with_errors(f), ["run_id"], {"p95": (F.col("lateral_err"), 0.95)}), errors("SELECT run_id, quantile_cont(abs(dn * cos(gt_yaw) - de * sin(gt_yaw)), 0.95) AS p95 FROM e GROUP BY run_id"), "p95", "run_id")
NEES2 = "(cov_nn * de * de - 2 * cov_en * de * dn + cov_ee * dn * dn) / (cov_ee * cov_nn - cov_en * cov_en)"
YAW = "(est_yaw - gt_yaw)"
NEES3 = f"""((cov_nn * cov_yy - cov_ny * cov_ny) * de * de + (cov_ee * cov_yy - cov_ey * cov_ey) * dn * dn + (cov_ee * cov_nn - cov_en * cov_en) * {YAW} * {YAW}
 + 2 * ((cov_ey * cov_ny - cov_en * cov_yy) * de * dn + (cov_en * cov_ny - cov_ey * cov_nn) * de * {YAW} + (cov_en * cov_ey - cov_ee * cov_ny) * dn * {YAW}))
 / (cov_ee * (cov_nn * cov_yy - cov_ny * cov_ny) - cov_en * (cov_en * cov_yy - cov_ny * cov_ey) + cov_ey * (cov_en * cov_ny - cov_nn * cov_ey))"""
add("a10_nees_samples", "fixes", lambda f: m.nees(f).select("ord", "nees"), errors(f"SELECT ord, {NEES2} AS nees FROM e"), "nees", "ord", 5)
add("a11_nees_mean", "fixes", lambda f: m.nees(f, 3).groupBy("run_id").agg(F.avg("nees").alias("nees")), errors(f"SELECT run_id, avg({NEES3}) AS nees FROM e GROUP BY run_id"), "nees", "run_id", 4)
add("a13_sigma_coverage", "fixes", lambda f: m.with_errors(f).agg(*(m.sigma_coverage(None, float(k)).alias(f"k{k}") for k in (1, 2, 3))), errors("SELECT " + ", ".join(f"avg(CASE WHEN err <= {k} * sqrt(cov_ee + cov_nn) THEN 1e0 ELSE 0e0 END) AS k{k}" for k in (1, 2, 3)) + " FROM e"), "k1, k2, k3")
add(
    "a15_quality_distribution", "fixes", m.quality_distribution,
    " UNION ALL ".join(f"SELECT '{a}' AS attribute, quantile_cont(CAST({a} AS DOUBLE), 0.05) AS p5, quantile_cont(CAST({a} AS DOUBLE), 0.5) AS median, quantile_cont(CAST({a} AS DOUBLE), 0.95) AS p95 FROM fixes WHERE accepted" for a in m.QUALITY),
    "p5, median, p95", "attribute",
)
add("a18_by_terrain", "fixes", lambda f: m.fix_level(f.filter(F.col("terrain").isin(*m.TERRAIN)), ("terrain",)), errors(f"SELECT terrain, {AGG} FROM e WHERE terrain IN ({TERRAIN}) GROUP BY terrain"), FIGURES, "terrain, n_attempts, n_accepted")
add("a19_terrain_counts", "fixes", lambda f: f.filter(F.col("terrain").isin(*m.TERRAIN)).groupBy("terrain").agg(F.count("*").alias("n")), f"SELECT terrain, count(*) AS n FROM fixes WHERE terrain IN ({TERRAIN}) GROUP BY terrain")
add("a25_match_summary", "fixes", m.match_summary, errors("SELECT count(*) AS n, median(err) AS median, quantile_cont(err, 0.95) AS p95, avg(CASE WHEN err <= 20 THEN 1e0 ELSE 0e0 END) FILTER (WHERE accepted) AS a_at_20, avg(CASE WHEN err > 50 THEN 1e0 ELSE 0e0 END) FILTER (WHERE accepted) AS ifr_at_50 FROM e"), "median, p95, a_at_20, ifr_at_50", "n")
add("a41_circular_mean", "fixes", lambda f: f.groupBy("terrain").agg(angles.circular_mean(F.col("est_yaw")).alias("mean")), "SELECT terrain, atan2(sum(sin(est_yaw)), sum(cos(est_yaw))) AS mean FROM fixes GROUP BY terrain", "mean", "terrain")
add("a42_upper_median", "fixes", lambda f: m.upper_median(f, ["run_id"], "n_inliers"), "SELECT run_id, list_sort(list(n_inliers))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median FROM fixes GROUP BY run_id")
add("v07_recall_curve", "fixes", m.recall_curve, errors(" UNION ALL ".join(f"SELECT {d}e0 AS distance_m, coalesce(avg(CASE WHEN err <= {d} THEN 1e0 ELSE 0e0 END) FILTER (WHERE accepted), 0e0) AS recall FROM e" for d in m.RECALL_M)), "recall", "distance_m")


def _halves(f: DataFrame) -> DataFrame:
    return m.compare_golden(m.key_metrics(f.filter("ord % 2 = 0")), m.key_metrics(f.filter("ord % 2 = 1")))


KEYS = ("a_at_20", "acceptance_rate", "ifr", "re_p95_deg", "latency_p95_ms")
_key = lambda side: " UNION ALL ".join(f"SELECT '{k}' AS metric, CAST({k} AS DOUBLE) AS value FROM {side}" for k in KEYS)
GOLDEN = (
    f"WITH {err()}, a AS (SELECT {AGG} FROM e WHERE ord % 2 = 0), b AS (SELECT {AGG} FROM e WHERE ord % 2 = 1), c AS ({_key('a')}), g AS ({_key('b')}) "
    "SELECT c.metric, c.value AS cur, g.value AS gold, c.value - g.value AS delta, CASE WHEN c.metric = 'ifr' THEN CASE WHEN c.value - g.value > 1e-3 THEN 'FAIL' ELSE 'PASS' END "
    "WHEN c.metric IN ('a_at_20', 'acceptance_rate') THEN CASE WHEN c.value < g.value * 95e-2 THEN 'FAIL' ELSE 'PASS' END ELSE CASE WHEN c.value > g.value * 105e-2 THEN 'FAIL' ELSE 'PASS' END END AS verdict FROM c JOIN g ON c.metric = g.metric"
)
add("a17_golden_compare", "fixes", _halves, GOLDEN, "cur, gold, delta", "metric, verdict")
add("j17_golden_verdict", "fixes", lambda f: m.overall_verdict(_halves(f)), f"SELECT CASE WHEN count(*) FILTER (WHERE verdict = 'FAIL') > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM ({GOLDEN})")
add("p01_accept_gate", "matches", lambda x: x.groupBy(m.accept_gate().alias("accepted")).agg(F.count("*").alias("n")), "SELECT success AND NOT bad_scale AND peak_ratio >= 12e-1 AND valid_fraction >= 3e-1 AS accepted, count(*) AS n FROM matches GROUP BY 1")
add("p03_p04_bias", "fixes", lambda f: f.select("ord", (F.col("gt_east") + 3.0).alias("shifted_east"), (F.col("est_north") - 4.0).alias("corrected_north")), "SELECT ord, gt_east + 3e0 AS shifted_east, est_north - 4e0 AS corrected_north FROM fixes", "shifted_east, corrected_north", "ord")
add("p05_covariance_matrix", "fixes", lambda f: f.select("ord", covariance.matrix(covariance.columns()).alias("c")).select("ord", F.col("c")[0][1].alias("c01"), F.col("c")[2][1].alias("c21"), F.col("c")[2][2].alias("c22")), "SELECT ord, cov_en AS c01, cov_ny AS c21, cov_yy AS c22 FROM fixes", "c01, c21, c22", "ord")
add("p26_covariance_validity", "fixes", lambda f: f.groupBy(covariance.is_valid(covariance.columns()).alias("valid")).agg(F.count("*").alias("n")), "SELECT cov_ee > 1e-12 AND cov_ee * cov_nn - cov_en * cov_en > 1e-12 AND cov_ee * (cov_nn * cov_yy - cov_ny * cov_ny) - cov_en * (cov_en * cov_yy - cov_ny * cov_ey) + cov_ey * (cov_en * cov_ny - cov_nn * cov_ey) > 1e-12 AS valid, count(*) AS n FROM fixes GROUP BY 1")
add("f01_f03_errors", "fixes", lambda f: m.with_errors(f).select("ord", "pos_err", "yaw_err_deg", "lateral_err"), errors("SELECT ord, err AS pos_err, yerr AS yaw_err_deg, abs(dn * cos(gt_yaw) - de * sin(gt_yaw)) AS lateral_err FROM e"), "pos_err, yaw_err_deg, lateral_err", "ord")
add("f04_f37_radius", "fixes", lambda f: f.select("ord", covariance.sigma_position(covariance.columns()).alias("sigma"), covariance.prior_radius(covariance.columns(), 5.0, 12.0, 16.0).alias("radius")), "SELECT ord, sqrt(cov_ee + cov_nn) AS sigma, least(greatest(3 * sqrt(cov_ee + cov_nn) + 5, 12), 16) AS radius FROM fixes", "sigma, radius", "ord")
add("f05_f07_angles", "fixes", lambda f: f.select("ord", angles.normalize(F.col("latency_ms")).alias("a"), angles.normalize_half_open(F.col("latency_ms")).alias("b"), angles.angle_diff(F.col("latency_ms"), F.col("est_yaw")).alias("d")), "SELECT ord, latency_ms - 2 * pi() * round_even(latency_ms / (2 * pi()), 0) AS a, (latency_ms + pi()) - 2 * pi() * floor((latency_ms + pi()) / (2 * pi())) - pi() AS b, (latency_ms - est_yaw) - 2 * pi() * round_even((latency_ms - est_yaw) / (2 * pi()), 0) AS d FROM fixes", "a, b, d", "ord")
add(
    "f35_pose_algebra", "fixes",
    lambda f: f.select("ord", angles.between(angles.pose(F.col("gt_east"), F.col("gt_north"), F.col("gt_yaw")), angles.pose(F.col("est_east"), F.col("est_north"), F.col("est_yaw"))).alias("p")).select("ord", "p.x", "p.y", "p.yaw"),
    "SELECT ord, cos(gt_yaw) * (est_east - gt_east) + sin(gt_yaw) * (est_north - gt_north) AS x, cos(gt_yaw) * (est_north - gt_north) - sin(gt_yaw) * (est_east - gt_east) AS y, est_yaw - gt_yaw AS yaw FROM fixes", "x, y, yaw", "ord",
)
add(
    "f36_covariance_floor", "fixes",
    lambda f: (lambda c: f.select("ord", *(c[k].alias(k) for k in ("ee", "nn", "yy"))))(covariance.floored(covariance.add_systematic(covariance.columns(), 0.5), 2.0, 0.2)),
    "SELECT ord, greatest(cov_ee + 25e-2, 4e0) AS ee, greatest(cov_nn + 25e-2, 4e0) AS nn, greatest(cov_yy, 4e-2) AS yy FROM fixes", "ee, nn, yy", "ord",
)
add("f38_gate", "fixes", lambda f: m.nees(f, 3).groupBy((F.col("nees") <= covariance.GATE_99).alias("inside")).agg(F.count("*").alias("n")), errors(f"SELECT {NEES3} <= 1134e-2 AS inside, count(*) AS n FROM e GROUP BY 1"))
add("k01_worst_fixes", "fixes", lambda f: m.with_errors(f).orderBy(F.desc("pos_err"), "ord").limit(50).select("ord", "pos_err"), errors("SELECT ord, err AS pos_err FROM e ORDER BY err DESC, ord LIMIT 50"), "pos_err", "ord")
add(
    "n21_match_to_fix", "matches",
    lambda x: x.select("id", (F.col("shift_east_px") * 0.5).alias("delta_east"), (F.col("shift_north_px") * 0.5).alias("delta_north"), angles.normalize(-F.col("delta_yaw")).alias("delta_yaw"), F.pow(3.0 * F.greatest(F.lit(1.0), 1.2 / F.greatest("peak_ratio", F.lit(1e-3))), F.lit(2.0)).alias("var_pos")),
    "SELECT id, shift_east_px * 5e-1 AS delta_east, shift_north_px * 5e-1 AS delta_north, -delta_yaw AS delta_yaw, pow(3 * greatest(1e0, 12e-1 / greatest(peak_ratio, 1e-3)), 2) AS var_pos FROM matches", "delta_east, delta_north, delta_yaw, var_pos", "id",
)
def _reason():
    peak, late, seen = F.col("peak_ratio") < 0.3, F.col("latency_ms") > 100, F.col("covisibility") < 0.1
    return F.when(peak, "peak").when(late, "latency").when(seen, "covisibility").otherwise("accepted")


add("x04_rejection_reasons", "fixes", lambda f: f.groupBy(_reason().alias("reason")).agg(F.count("*").alias("n")), "SELECT CASE WHEN peak_ratio < 3e-1 THEN 'peak' WHEN latency_ms > 100 THEN 'latency' WHEN covisibility < 1e-1 THEN 'covisibility' ELSE 'accepted' END AS reason, count(*) AS n FROM fixes GROUP BY 1")
add("x10_local_bias_map", "fixes", lambda f: m.with_errors(f).groupBy(F.floor(F.col("gt_east") / 100).alias("cell")).agg(F.avg("east_err").alias("bias_e"), F.avg("north_err").alias("bias_n"), F.stddev_samp("pos_err").alias("spread")).withColumn("level", F.when(F.hypot("bias_e", "bias_n") > 8, "reject").when(F.hypot("bias_e", "bias_n") > 3, "warn").otherwise("ok")), errors("SELECT cell, be AS bias_e, bn AS bias_n, s AS spread, CASE WHEN sqrt(be * be + bn * bn) > 8 THEN 'reject' WHEN sqrt(be * be + bn * bn) > 3 THEN 'warn' ELSE 'ok' END AS level FROM (SELECT CAST(floor(gt_east / 100) AS BIGINT) AS cell, avg(de) AS be, avg(dn) AS bn, stddev_samp(err) AS s FROM e GROUP BY 1)"), "bias_e, bias_n, spread", "cell, level")


def _summary(f: DataFrame) -> DataFrame:
    made = m.summary(f, (3.0, 4.0), seed=7)
    sides = [F.col(f"{struct}.{c}").alias(f"{c}{end}") for struct, end in (("fix_level", ""), ("fix_level_without_bias", "_b")) for c in ("n_accepted", *FIGURES.split(", ")) if not end or c in ("a_at_5", "a_at_20", "a_at_50", "ifr")]
    quality = [F.col("quality")[i][n].alias(f"{a}_{n}") for i, a in enumerate(m.QUALITY) for n in ("p5", "median", "p95")]
    return made.select("scope", F.col("run.seed").alias("seed"), "n", *sides, *quality)


QUANTILES = ", ".join(f"quantile_cont(CAST({a} AS DOUBLE), {q}) FILTER (WHERE accepted) AS {a}_{n}" for a in m.QUALITY for n, q in (("p5", 0.05), ("median", 0.5), ("p95", 0.95)))
UNBIASED = ", ".join(f"avg(CASE WHEN errb <= {d} THEN 1e0 ELSE 0e0 END) FILTER (WHERE accepted) AS a_at_{d}_b" for d in (5, 20, 50)) + ", avg(CASE WHEN errb > 50 THEN 1e0 ELSE 0e0 END) FILTER (WHERE accepted) AS ifr_b"
SUMMED = f"SELECT coalesce(scope, 'all') AS scope, CAST(7 AS BIGINT) AS seed, count(*) AS n, {AGG.replace('count(*) AS n_attempts, ', '')}, {UNBIASED}, {QUANTILES} FROM (SELECT *, sqrt(pow(de - 3, 2) + pow(dn - 4, 2)) AS errb, CASE WHEN terrain IN ({TERRAIN}) THEN terrain END AS scope FROM e) z GROUP BY GROUPING SETS ((), (scope)) HAVING grouping(scope) = 1 OR scope IS NOT NULL"
add("a23_summary", "fixes", _summary, errors(SUMMED), ", ".join([FIGURES, "a_at_5_b, a_at_20_b, a_at_50_b, ifr_b", *(f"{a}_{n}" for a in m.QUALITY for n in ("p5", "median", "p95"))]), "scope, seed, n, n_accepted")
_swept = lambda f: m.sweep(f.withColumn("level", F.floor("latency_ms") % 10), "level").select(F.coalesce("level", F.lit(-1)).alias("level"), "total", "n_attempts", "a_at_20", "ifr", "rmse")
add("x11_error_by_sweep", "fixes", _swept, errors("SELECT coalesce(CAST(floor(latency_ms) % 10 AS BIGINT), -1) AS level, CAST(grouping(CAST(floor(latency_ms) % 10 AS BIGINT)) AS TINYINT) AS total, count(*) AS n_attempts, avg(CASE WHEN err <= 20 THEN 1e0 ELSE 0e0 END) FILTER (WHERE accepted) AS a_at_20, avg(CASE WHEN err > 50 THEN 1e0 ELSE 0e0 END) FILTER (WHERE accepted) AS ifr, sqrt(avg(err * err) FILTER (WHERE accepted)) AS rmse FROM e GROUP BY ROLLUP (CAST(floor(latency_ms) % 10 AS BIGINT))"), "a_at_20, ifr, rmse", "level, total, n_attempts")
