"""Outages and recovery: sessions of fixes, their density, and covariances that grow between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordered import in_blocks


def sessions(fixes: DataFrame, gap_s: float, late: str = "10 minutes") -> DataFrame:
    """Spans of fixes (run_id, ts, path_m, nominal) with less than ``gap_s`` between neighbours; batch or stream.

    Returns run_id, begun, ended (first and last fix), nominal_at (first nominal one, or null), n,
    path_from and path_to.  As a stream it emits a session once the watermark is ``gap_s`` past it.
    """
    timed = fixes.withWatermark("ts", late) if fixes.isStreaming else fixes
    made = timed.groupBy("run_id", F.session_window("ts", f"{round(gap_s * 1000)} milliseconds").alias("w")).agg(
        F.min("ts").alias("begun"), F.max("ts").alias("ended"), F.min(F.when(F.col("nominal"), F.col("ts"))).alias("nominal_at"), F.count("*").alias("n"), F.min("path_m").alias("path_from"), F.max("path_m").alias("path_to")
    )
    return made.drop("w")


def recoveries(spans: DataFrame, least_m: float = 2000.0) -> DataFrame:
    """Per outage (between two sessions of a run) of ``least_m`` or more: its length on the path and the seconds until a nominal fix.

    A session without a nominal fix has null: the run did not recover before the next outage.
    """
    before = F.lag("path_to").over(W.partitionBy("run_id").orderBy("begun"))
    seconds = F.unix_micros("nominal_at") - F.unix_micros("begun")
    out = spans.select("run_id", "begun", (F.col("path_from") - before).alias("outage_m"), (seconds / 1e6).alias("recovery_s"))
    return out.filter(F.col("outage_m") >= least_m)


def fixes_per_km(track: DataFrame) -> DataFrame:
    """Per run: accepted fixes for each kilometre of its path, null for a run that does not move."""
    return track.groupBy("run_id").agg(F.try_divide(F.count_if("accepted") * 1000.0, F.max("path_m") - F.min("path_m")).alias("fixes_per_km"))


def growing_covariance(track: DataFrame, sigma: str = "sigma") -> DataFrame:
    """Per run: whether ``sigma`` never falls from one coasting sample to the next, and how often it does; samples of one ord go by ``sigma``, then coasting ones last."""
    order = ("ord", sigma, "coasting")
    w = W.partitionBy("run_id", "__block").orderBy(*order)
    falls = F.col("coasting") & F.lag("coasting").over(w) & (F.col(sigma) < F.lag(sigma).over(w))
    rows = in_blocks(track.select("run_id", *order), 1, order=order)
    return rows.select("run_id", F.coalesce(falls, F.lit(False)).alias("__f"), "__own").filter("__own").groupBy("run_id").agg(F.count_if("__f").alias("falls"), F.every(~F.col("__f")).alias("monotone"))
