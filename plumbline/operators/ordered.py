"""Ordered analytics over tracks: gaps, integrals, baselines, as-of interpolation.

Every window names its partition and a unique order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import angles
from .quantiles import same_keys

#: Rows of a run beyond which it is ordered in blocks, and their number.
LARGE, BLOCKS = 100_000, 64


def by_order(run: str = "run_id", order: tuple[str, ...] = ("ord",)):
    return W.partitionBy(run).orderBy(*order)


def in_blocks(track: DataFrame, back: int, run: str = "run_id", order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """Rows with __block, so that windows by run and block look back over ``back`` rows as those by run do.

    A large run is cut at quantiles of its order; rows before a block's first are there again,
    with __own false, to be left out afterwards.  Rows of one place in the order are in one block.
    """
    cuts = track.groupBy(run).agg(F.count("*").alias("__n"), F.percentile_approx(order[0], [i / BLOCKS for i in range(1, BLOCKS)], 1000).alias("__cuts")).filter(F.col("__n") > LARGE).drop("__n")
    block = F.when(F.col("__cuts").isNull(), 0).otherwise(F.size(F.filter("__cuts", lambda c: c < F.col(order[0]))))
    rows = same_keys(track, F.broadcast(cuts), [run], "left").withColumn("__block", block).drop("__cuts")
    last = F.row_number().over(W.partitionBy(run, "__block").orderBy(*(F.desc(c) for c in order)))
    ends = rows.withColumn("__last", last).filter(F.col("__last") <= back).groupBy(run, "__block").agg(F.collect_list(F.struct(*track.columns)).alias("__rows"))
    before = F.flatten(F.collect_list("__rows").over(W.partitionBy(run).orderBy("__block").rowsBetween(-back, -1)))
    carried = ends.withColumn("__before", before).select("__block", F.explode("__before").alias("__row")).select("__row.*", "__block", F.lit(False).alias("__own"))
    return rows.withColumn("__own", F.lit(True)).unionByName(carried)


def first_where(value: str, cond: Column, order: str = "ord") -> Column:
    """Aggregate: the value of the first row, in order, for which ``cond`` holds."""
    return F.min_by(F.when(cond, F.col(value)), F.when(cond, F.col(order)))


def max_gap(track: DataFrame, value: str = "path_m", run: str = "run_id", order: str = "ord") -> DataFrame:
    """Greatest step of ``value`` between neighbouring accepted rows of a run; null for fewer than two."""
    step = F.col(value) - F.lag(value).over(by_order(run, (order,)))
    return track.filter("accepted").withColumn("gap", step).groupBy(run).agg(F.max("gap").alias("max_gap"))


def time_to_first(track: DataFrame, run: str = "run_id") -> DataFrame:
    """Time from a run's first row to its first accepted one."""
    return track.groupBy(run).agg((first_where("t_s", F.col("accepted")) - F.min_by("t_s", "ord")).alias("ttff_s"))


def running_path(track: DataFrame, x: str, y: str, run: str = "run_id", order: str = "ord") -> DataFrame:
    """Add path_m, the length walked so far."""
    w = by_order(run, (order,))
    step = F.coalesce(F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)), F.lit(0.0))
    return track.withColumn("__step", step).withColumn("path_m", F.sum("__step").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__step")


def integrate(track: DataFrame, rate: str, out: str, run: str = "run_id", order: str = "ord", time: str = "t_s") -> DataFrame:
    """Trapezoidal running integral of ``rate`` over ``time``, 0 at a run's first row."""
    w = by_order(run, (order,))
    area = (F.col(time) - F.lag(time).over(w)) * (F.col(rate) + F.lag(rate).over(w)) / 2
    return track.withColumn("__a", F.coalesce(area, F.lit(0.0))).withColumn(out, F.sum("__a").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__a")


def baseline_ratio(track: DataFrame, baseline_s: float = 3.0, least_m: float = 5.0, run: str = "run_id") -> DataFrame:
    """Displacement of positions over that of integrated velocity, on a baseline of whole rows.

    The step is the baseline over the run's median row interval, one row at least.  Returns
    ratio (median), ratio_min, ratio_max and n per run with a baseline of ``least_m`` or more.
    """
    w = by_order(run)
    both = integrate(integrate(track, "v_east", "i_east", run), "v_north", "i_north", run)
    step = track.withColumn("dt", F.col("t_s") - F.lag("t_s").over(w)).groupBy(run).agg(F.percentile("dt", F.lit(0.5)).alias("dt"))
    step = step.select(run, F.greatest(F.lit(1), F.rint(F.lit(baseline_s) / F.col("dt")).cast("int")).alias("step"))
    numbered = both.withColumn("n", F.row_number().over(w)).join(step, run)
    ahead = numbered.select(run, (F.col("n") - F.col("step")).alias("n"), *(F.col(c).alias(f"{c}_2") for c in ("east", "north", "i_east", "i_north")))
    pairs = numbered.join(ahead, [run, "n"])
    moved = pairs.withColumns({"dp": F.hypot(F.col("east_2") - F.col("east"), F.col("north_2") - F.col("north")), "di": F.hypot(F.col("i_east_2") - F.col("i_east"), F.col("i_north_2") - F.col("i_north"))})
    r = moved.filter(F.col("di") >= least_m).withColumn("r", F.col("dp") / F.col("di"))
    return r.groupBy(run).agg(F.median("r").alias("ratio"), F.min("r").alias("ratio_min"), F.max("r").alias("ratio_max"), F.count("*").alias("n"))


def as_of(left: DataFrame, right: DataFrame, values: list[str], run: str = "run_id", time: str = "t_s") -> DataFrame:
    """Both neighbours of each left row among the right rows of its run, in one sort, without a range join.

    Adds ``prev_<time>``, ``next_<time>`` and prev/next of each value: the last right row at
    or before, the first at or after.  Left rows may repeat; right times are unique in a run.
    """
    kept = [c for c in left.columns if c not in (run, time)]
    rows = left.select(run, time, F.lit(1).alias("__side"), F.struct(*kept, F.lit(0).alias("__")).alias("__row"), F.lit(None).cast(right.select(F.struct(time, *values)).schema[0].dataType).alias("__ref"))
    refs = right.select(run, time, F.lit(0).alias("__side"), F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"), F.struct(time, *values).alias("__ref"))
    both = rows.unionByName(refs)
    back = W.partitionBy(run).orderBy(time, "__side").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(run).orderBy(F.col(time).desc(), "__side").rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumns({"__p": F.last("__ref", ignorenulls=True).over(back), "__n": F.last("__ref", ignorenulls=True).over(ahead)}).filter("__side = 1")
    cols = [F.col(f"__{a[0]}.{c}").alias(f"{a}_{c}") for a in ("prev", "next") for c in (time, *values)]
    return found.select(run, time, *(F.col(f"__row.{c}").alias(c) for c in kept), *cols)


def interpolate(left: DataFrame, right: DataFrame, values: list[str], run: str = "run_id", time: str = "t_s", max_gap: float | None = None) -> DataFrame:
    """Linear interpolation of the right rows at the left times; the nearest row beyond the ends.

    With ``max_gap``, the previous row is held where its neighbours are further apart.
    """
    found = as_of(left, right, values, run, time)
    p, n = F.col(f"prev_{time}"), F.col(f"next_{time}")
    f = F.when(p.isNull(), 1.0).when(n.isNull() | (n == p), 0.0).otherwise((F.col(time) - p) / (n - p))
    f = F.when((n - p) > max_gap, 0.0).otherwise(f) if max_gap is not None else f
    made = {v: F.coalesce(F.col(f"prev_{v}"), F.col(f"next_{v}")) * (1 - f) + F.coalesce(F.col(f"next_{v}"), F.col(f"prev_{v}")) * f for v in values}
    return found.withColumns(made).drop(*(f"{a}_{c}" for a in ("prev", "next") for c in (time, *values)))


def ecdf(df: DataFrame, value: str, by: list[str], order: str) -> DataFrame:
    """Add cdf = rank / count, ties in the order of ``order``."""
    return df.withColumn("cdf", F.row_number().over(W.partitionBy(*by).orderBy(value, order)) / F.count("*").over(W.partitionBy(*by)))


def innovations(fixes: DataFrame, run: str = "run_id") -> DataFrame:
    """Constant-velocity prediction error of each accepted fix from the two before it.

    The heading is predicted to stay; prev_cov_* is the covariance of the fix before, if there are any.
    """
    w = W.partitionBy(run, "__block").orderBy("ord")
    df = in_blocks(fixes.filter("accepted"), 2, run)
    for a in ("east", "north"):
        p, q = F.lag(f"est_{a}").over(w), F.lag(f"est_{a}", 2).over(w)
        tp, tq = F.lag("t_s").over(w), F.lag("t_s", 2).over(w)
        df = df.withColumn(f"innov_{a}", F.col(f"est_{a}") - (p + F.try_divide((p - q) * (F.col("t_s") - tp), tp - tq)))
    if "est_yaw" in df.columns:
        df = df.withColumn("innov_yaw", angles.normalize(F.col("est_yaw") - F.lag("est_yaw").over(w)))
    return df.withColumns({f"prev_{c}": F.lag(c).over(w) for c in df.columns if c.startswith("cov_")}).filter("__own").drop("__block", "__own")


def request_rate(track: DataFrame, run: str = "run_id") -> DataFrame:
    """Add um_per_s, the speed between consecutive requests in whole micrometres a second; null at the first and for no time.

    Paths are whole centimetres (path_cm) and times whole seconds (ord), so nothing is rounded but the quotient, down to 0.
    """
    w = by_order(run)
    moved, took = F.col("path_cm") - F.lag("path_cm").over(w), F.col("ord") - F.lag("ord").over(w)
    return track.withColumns({"__moved": moved * 10000, "__took": F.nullif(took, F.lit(0))}).withColumn("um_per_s", F.expr("__moved div __took")).drop("__moved", "__took")


def moved_over(track: DataFrame, value: str, rows: int, run: str = "run_id") -> DataFrame:
    """Add moved, the change of ``value`` over the next ``rows`` rows of the run; null at its end."""
    return track.withColumn("moved", F.lead(value, rows).over(by_order(run)) - F.col(value))


def look_ahead(track: DataFrame, seconds: float, tile: float) -> DataFrame:
    """Add tile_e and tile_n, the tile that a position (east, north) reaches in ``seconds`` at its speed (v_east, v_north): what to fetch ahead."""
    at = lambda a: F.floor((F.col(a) + F.col(f"v_{a}") * seconds) / tile)
    return track.withColumns({"tile_e": at("east"), "tile_n": at("north")})


def sliding_windows(df: DataFrame, time: str, length: float, step: float) -> DataFrame:
    """A row per window [k step, k step + length) that holds the row's time; k from 0."""
    last = F.floor(F.col(time) / step)
    first = F.greatest(F.lit(0), F.floor((F.col(time) - length) / step) + 1)
    return df.withColumn("window", F.explode(F.sequence(first, last)))
