"""Accuracy, integrity and consistency of position fixes.

Accuracy is over accepted rows only; availability is its own figure.  Rates over no rows are
null.  A NaN error is within no distance and beyond none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import angles, covariance
from .ordered import in_blocks
from .quantiles import Wanted, exact_quantiles, same_keys

TERRAIN = ("urban", "suburban", "roads", "farmland", "forest", "water", "background")
INTEGRITY_M = 50.0
QUALITY = ("n_inliers", "inlier_ratio", "covisibility", "peak_ratio", "residual_rms_px", "spatial_spread", "mean_confidence")
RECALL_M = (1.0, 2.0, 3.0, 5.0, 7.0, 10.0, 15.0, 20.0, 30.0, 50.0, 100.0)


def with_errors(fixes: DataFrame, bias: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Add east_err, north_err (less a map bias), pos_err, yaw_err_deg and lateral_err."""
    e, n = F.col("est_east") - F.col("gt_east") - bias[0], F.col("est_north") - F.col("gt_north") - bias[1]
    df = fixes.withColumns({"east_err": e, "north_err": n, "yaw_err_deg": angles.yaw_error_deg(F.col("est_yaw"), F.col("gt_yaw"))})
    return df.withColumns({"pos_err": angles.position_error(F.col("east_err"), F.col("north_err")), "lateral_err": angles.lateral_error(F.col("east_err"), F.col("north_err"), F.col("gt_yaw"))})


def share(cond: Column, where: Column) -> Column:
    """Share of the rows ``where`` for which ``cond`` holds; null for no rows."""
    return F.avg(F.when(where, F.when(cond, 1.0).otherwise(0.0)))


def within(d: float, err: str = "pos_err", where: str = "accepted") -> Column:
    """Share of accepted errors up to ``d``."""
    return share((F.col(err) <= d) & ~F.isnan(err), F.col(where))


def beyond(d: float = INTEGRITY_M, err: str = "pos_err", where: str = "accepted") -> Column:
    """Share of accepted errors above ``d``: the integrity failure rate."""
    return share((F.col(err) > d) & ~F.isnan(err), F.col(where))


def accepted(column: str) -> Column:
    """The column's value on accepted rows, null on others."""
    return F.when(F.col("accepted"), F.col(column))


def upper_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The value at rank floor(n / 2) + 1 of each group, nulls first, from the running count of its distinct values."""
    w = W.partitionBy(*by)
    counts = df.groupBy(*by, value).agg(F.count("*").alias("__n"))
    counts = counts.withColumns({"__upto": F.sum("__n").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)), "__all": F.sum("__n").over(w)})
    return counts.filter(F.col("__upto") > F.floor(F.col("__all") / 2)).groupBy(*by).agg(F.min(F.struct("__upto", value))[value].alias("median"))


def fix_rates() -> list[Column]:
    """Those of the twelve figures of a set of fixes that are counts and shares."""
    return [
        F.count("*").alias("n_attempts"),
        F.count_if("accepted").alias("n_accepted"),
        F.try_divide(F.count_if("accepted"), F.count("*")).alias("acceptance_rate"),
        *(within(float(d)).alias(f"a_at_{d}") for d in (5, 10, 20, 50)),
        beyond().alias("ifr"),
    ]


def _quantiles() -> dict[str, tuple[Column, float]]:
    yaw, late = accepted("yaw_err_deg"), F.col("latency_ms")
    return {"re_med_deg": (yaw, 0.5), "re_p95_deg": (yaw, 0.95), "latency_p50_ms": (late, 0.5), "latency_p95_ms": (late, 0.95)}


def _attributes() -> dict[str, tuple[Column, float]]:
    return {f"{a}_{n}": (accepted(a), q) for a in QUALITY for n, q in (("p5", 0.05), ("median", 0.5), ("p95", 0.95))}


def fix_quantiles(df: DataFrame, by: list[str], few: bool = False) -> DataFrame:
    """Those that are quantiles: of the heading error where accepted, and of the latency."""
    return exact_quantiles(df, by, _quantiles(), few)


def fix_level(fixes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The twelve figures by group, or overall."""
    df = with_errors(fixes)
    return same_keys(df.groupBy(*by).agg(*fix_rates()), fix_quantiles(df, list(by)), list(by), "left")


def _scopes(asked: Wanted, fixes: DataFrame, aggregates: list[Column], columns: list[str]) -> DataFrame:
    """``aggregates`` and quantiles overall (scope 'all') and by listed terrain class, by GROUPING SETS.

    Labels outside the list only count overall.  The first pass has all sums and bounds, the
    second settles the quantiles; of the eight scopes at most a row each goes to all tasks.
    """
    listed = F.when(F.col("terrain").isin(*TERRAIN), F.col("terrain"))
    rows = fixes.select(listed.alias("scope"), *columns, *asked.values())
    sets = rows.groupingSets([[], ["scope"]], "scope").agg(F.grouping("scope").alias("__all"), *aggregates, *asked.ends())
    sets = sets.filter("__all = 1 OR scope IS NOT NULL").withColumn("scope", F.coalesce("scope", F.lit("all")))
    both = F.array_compact(F.array(F.lit("all"), F.col("scope")))
    values = rows.select(F.explode(both).alias("scope"), *asked.columns)
    made = asked.settle(values, sets, ["scope"], few=True)
    return sets.join(F.broadcast(made), "scope", "left").drop("__all", *(f"{a}{e}" for a in asked.columns for e in "nlhb"))


def fix_level_by_terrain(fixes: DataFrame) -> DataFrame:
    """Overall ('all') and by listed terrain class; labels outside the list only count overall."""
    made = _scopes(Wanted(_quantiles()), with_errors(fixes), fix_rates(), ["accepted", "pos_err"])
    return made.withColumnRenamed("scope", "terrain")


def _sides(bias: tuple[float, float]) -> list[Column]:
    """The shares that a map bias changes, with it (left in) and without it (taken off)."""
    return [c(e).alias(f"{n}_{side}") for side, e in (("with", "pos_err"), ("without", "pos_err_b")) for n, c in ((*((f"a_at_{d}", lambda e, d=d: within(float(d), e)) for d in (5, 10, 20, 50)), ("ifr", lambda e: beyond(err=e))))]


_SHARED = ("n_attempts", "n_accepted", "acceptance_rate", "re_med_deg", "re_p95_deg", "latency_p50_ms", "latency_p95_ms")
_BIASED = ("a_at_5", "a_at_10", "a_at_20", "a_at_50", "ifr")


def _with_both(fixes: DataFrame, bias: tuple[float, float]) -> DataFrame:
    return with_errors(fixes).withColumn("pos_err_b", angles.position_error(F.col("east_err") - bias[0], F.col("north_err") - bias[1]))


def dual_bias(fixes: DataFrame, bias: tuple[float, float]) -> DataFrame:
    """The figures with the map bias and without it, side by side in one pass; a row each in the end."""
    df = _with_both(fixes, bias)
    wide = same_keys(df.agg(*fix_rates()[:3], *_sides(bias)), fix_quantiles(df, []), [])
    modes = F.array(*(F.struct(F.lit(m).alias("mode"), *(F.col(c) for c in _SHARED), *(F.col(f"{c}_{m}").alias(c) for c in _BIASED)) for m in ("with", "without")))
    return wide.select(F.explode(modes).alias("x")).select("x.*")


def summary(fixes: DataFrame, bias: tuple[float, float] = (0.0, 0.0), level: str = "B", target: str = "x86", git_sha: str = "", seed: int | None = None) -> DataFrame:
    """One row per scope (overall and by listed terrain class) with what a run's summary has.

    fix_level and fix_level_without_bias are structs of the twelve figures, quality an array of
    (attribute, p5, median, p95) over accepted rows; n counts the scope's rows, accepted or not.
    """
    asked = Wanted(_quantiles() | _attributes())
    made = _scopes(asked, _with_both(fixes, bias), [*fix_rates()[:3], *_sides(bias)], ["accepted", "pos_err", "pos_err_b"])
    figures = lambda side: F.struct(*(F.col(c) for c in _SHARED), *(F.col(f"{c}_{side}").alias(c) for c in _BIASED))
    quality = F.array(*(F.struct(F.lit(a).alias("attribute"), *(F.col(f"{a}_{n}").alias(n) for n in ("p5", "median", "p95"))) for a in QUALITY))
    head = F.struct(F.lit(level).alias("level"), F.lit(target).alias("target"), F.lit(git_sha).alias("git_sha"), F.lit(seed).cast("long").alias("seed"), F.lit(bias[0]).alias("bias_east"), F.lit(bias[1]).alias("bias_north"))
    return made.select(head.alias("run"), "scope", F.col("n_attempts").alias("n"), figures("with").alias("fix_level"), figures("without").alias("fix_level_without_bias"), quality.alias("quality"))


def sweep(fixes: DataFrame, parameter: str, bias: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """The error against a swept parameter: per value and over all (null, total) the shares and root mean square, by ROLLUP."""
    df = with_errors(fixes, bias)
    return df.rollup(parameter).agg(F.grouping(parameter).alias("total"), *fix_rates(), F.sqrt(F.avg(F.when(F.col("accepted"), F.col("pos_err") * F.col("pos_err")))).alias("rmse"))


def quality_distribution(fixes: DataFrame) -> DataFrame:
    """5th, 50th and 95th percentile of each quality attribute over accepted rows."""
    wide = exact_quantiles(fixes, [], _attributes())
    rows = F.array(*(F.struct(F.lit(a).alias("attribute"), *(F.col(f"{a}_{n}").alias(n) for n in ("p5", "median", "p95"))) for a in QUALITY))
    return wide.select(F.explode(rows).alias("x")).select("x.*")


def recall_curve(fixes: DataFrame, distances: tuple[float, ...] = RECALL_M) -> DataFrame:
    """Share of accepted errors within each distance, 0 where nothing is accepted; one pass, then unpivoted."""
    wide = with_errors(fixes).agg(*(within(d).alias(f"d{i}") for i, d in enumerate(distances)))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(d).alias("distance_m"), F.coalesce(f"d{i}", F.lit(0.0)).alias("recall")) for i, d in enumerate(distances)))).alias("x")).select("x.*")


def nees(fixes: DataFrame, dof: int = 2) -> DataFrame:
    """Add nees, the squared error over its covariance (2: planar, 3: with yaw); null where singular."""
    c = covariance.columns()
    df = with_errors(fixes).withColumn("yaw_err", angles.normalize(F.col("est_yaw") - F.col("gt_yaw")))
    d2 = covariance.mahalanobis2(F.col("east_err"), F.col("north_err"), c) if dof == 2 else covariance.mahalanobis3(F.col("east_err"), F.col("north_err"), F.col("yaw_err"), c)
    return df.withColumn("nees", d2)


def sigma_coverage(fixes: DataFrame, k: float) -> Column:
    """Aggregate over ``with_errors``: share of errors within k horizontal sigmas."""
    return F.avg(F.when(F.col("pos_err") <= k * covariance.sigma_position(covariance.columns()), 1.0).otherwise(0.0))


def rmse(err: str = "pos_err") -> Column:
    return F.sqrt(F.avg(F.col(err) * F.col(err)))


def innovation_consistency(innovations: DataFrame, dof: int = 2) -> DataFrame:
    """Add nis, the squared innovation (innov_east, innov_north, innov_yaw) over the sum of two fixes' covariances.

    Needs cov_* of the fix and prev_cov_* of the one before; null where singular or without innovation.
    """
    total = {k: F.col(f"cov_{k}") + F.col(f"prev_cov_{k}") for k in covariance.UPPER}
    e, n, y = (F.col(f"innov_{k}") for k in ("east", "north", "yaw"))
    return innovations.withColumn("nis", covariance.mahalanobis2(e, n, total) if dof == 2 else covariance.mahalanobis3(e, n, y, total))


def match_summary(fixes: DataFrame) -> DataFrame:
    """n, median and 95th percentile of the position error, share within 20 m and beyond 50 m of the accepted."""
    df = with_errors(fixes)
    shares = df.agg(F.count("*").alias("n"), within(20.0).alias("a_at_20"), beyond().alias("ifr_at_50"))
    return same_keys(shares, exact_quantiles(df, [], {"median": (F.col("pos_err"), 0.5), "p95": (F.col("pos_err"), 0.95)}), [])


def trajectory_level(track: DataFrame, run: str = "run_id", order: str = "ord", converged_deg: float = 1.0) -> DataFrame:
    """Per run: ate_rmse, lateral_p95, yaw_p95, convergence_m (path at the first yaw sigma below ``converged_deg``), max_gap_m.

    The widest gap is between neighbouring samples of the path, accepted or not.
    """
    df = with_errors(track).withColumn("__sigma", F.degrees(F.sqrt(F.greatest(F.col("cov_yy"), F.lit(0.0)))))
    gap = F.col("path_m") - F.lag("path_m").over(W.partitionBy(run, "__block").orderBy(order))
    gaps = in_blocks(df.select(run, order, "path_m"), 1, run, (order,)).withColumn("__gap", gap).filter("__own").groupBy(run).agg(F.max("__gap").alias("max_gap_m"))
    first = F.min(F.when(F.col("__sigma") < converged_deg, F.struct(order, "path_m")))["path_m"]
    sums = df.groupBy(run).agg(rmse().alias("ate_rmse"), first.alias("convergence_m"))
    sums = same_keys(sums, gaps, [run])
    return same_keys(sums, exact_quantiles(df, [run], {"lateral_p95": (F.col("lateral_err"), 0.95), "yaw_p95": (F.col("yaw_err_deg"), 0.95)}), [run], "left")


def early_fixes(track: DataFrame, within_m: float = 2000.0, run: str = "run_id") -> DataFrame:
    """Accepted samples of each run's first ``within_m`` metres."""
    return track.groupBy(run).agg(F.count_if(F.col("accepted") & (F.col("path_m") < within_m)).alias("n"))


def compare_golden(current: DataFrame, golden: DataFrame, rel_tol: float = 0.05, ifr_tol: float = 0.001, higher_better: tuple[str, ...] = ("a_at_20", "acceptance_rate")) -> DataFrame:
    """Per metric (metric, value): delta and whether it degraded past its tolerance.

    The integrity failure rate may rise by an absolute ``ifr_tol``; other metrics may be worse
    by ``rel_tol`` of the golden value.  A metric missing on one side is NOT_COMPUTED, which
    doesn't fail a run.
    """
    joined = current.withColumnRenamed("value", "cur").join(golden.withColumnRenamed("value", "gold"), "metric", "full_outer")
    worse = (
        F.when(F.col("metric") == "ifr", F.col("cur") - F.col("gold") > ifr_tol)
        .when(F.col("metric").isin(*higher_better), F.col("cur") < F.col("gold") * (1 - rel_tol))
        .otherwise(F.col("cur") > F.col("gold") * (1 + rel_tol))
    )
    verdict = F.when(F.col("cur").isNull() | F.col("gold").isNull(), "NOT_COMPUTED").when(worse, "FAIL").otherwise("PASS")
    return joined.select("metric", "cur", "gold", (F.col("cur") - F.col("gold")).alias("delta"), verdict.alias("verdict"))


def overall_verdict(compared: DataFrame) -> DataFrame:
    return compared.agg(F.when(F.count_if(F.col("verdict") == "FAIL") > 0, "FAIL").otherwise("PASS").alias("verdict"))


def key_metrics(fixes: DataFrame, names: tuple[str, ...] = ("a_at_20", "acceptance_rate", "ifr", "re_p95_deg", "latency_p95_ms")) -> DataFrame:
    """The figures that golden runs are compared by, a row each."""
    wide = fix_level(fixes)
    return wide.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names))).alias("x")).select("x.*")


def terrain_of(fractions: dict[str, Column]) -> Column:
    """Class of a window from its shares of water, building, farmland, forest and road; the first rule that holds."""
    water, building, farm, forest, road = (fractions[k] for k in ("water", "building", "farmland", "forest", "road"))
    return (
        F.when(water > 0.50, "water").when(building > 0.15, "urban").when(farm > 0.60, "farmland").when(forest > 0.60, "forest")
        .when((road > 0.05) & (building < 0.03), "roads").when(building >= 0.03, "suburban").otherwise("background")
    )


def accept_gate(min_peak: float = 1.2, min_valid: float = 0.3) -> Column:
    """Whether a match is good enough to publish."""
    return F.col("success") & ~F.col("bad_scale") & (F.col("peak_ratio") >= min_peak) & (F.col("valid_fraction") >= min_valid)


def class_of_tags(tags: Column) -> Column:
    """Raster class of a map feature's tags (road 1, building 2, water 3, farmland 4, forest 5), null if none."""
    has = lambda k: F.coalesce(F.map_contains_key(tags, k), F.lit(False))
    val = lambda k: F.coalesce(F.try_element_at(tags, F.lit(k)), F.lit(""))
    land = val("landuse")
    return (
        F.when((val("natural") == "water") | has("waterway") | land.isin("reservoir", "basin") | has("water"), 3)
        .when(has("building") | has("building:part"), 2)
        .when(has("highway"), 1)
        .when(land.isin("farmland", "farmyard") | has("farmland"), 4)
        .when(land.isin("forest", "forestry") | (val("natural") == "wood"), 5)
    )
