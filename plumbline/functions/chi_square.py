"""The chi-square distribution as Column expressions, for consistency tests of covariances."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Newton steps; from the start below each about doubles the digits.
NEWTON = 8


def _log_gamma_half(dof: Column) -> Column:
    """log of gamma(dof / 2 + 1) for a whole ``dof`` of 1 or more, as a sum of logs."""
    odd = dof % 2 == 1
    terms = F.sequence(F.lit(1), F.when(odd, (dof + 1) / 2).otherwise(dof / 2).cast("int"))
    start = F.when(odd, F.lit(math.log(math.pi) / 2)).otherwise(F.lit(0.0))
    return F.aggregate(terms, start, lambda s, k: s + F.log(F.when(odd, k - 0.5).otherwise(k.cast("double"))))


def _density_log(x: Column, dof: Column, log_gamma: Column) -> Column:
    """log of (x/2)^(dof/2) e^(-x/2) / gamma(dof/2 + 1)."""
    return dof / 2 * F.log(x / 2) - x / 2 - log_gamma


def _below(x: Column, dof: Column, log_gamma: Column) -> Column:
    """P(chi-square <= x) by the series of the incomplete gamma function, whose terms are all positive."""
    half = x / 2
    n = (half + 12 * F.sqrt(half) + 40).cast("int")
    first = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(s: Column, k: Column) -> Column:
        term = s["term"] * half / (dof / 2 + k)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    total = F.aggregate(F.sequence(F.lit(1), n), first, step, lambda s: s["sum"])
    return F.exp(_density_log(x, dof, log_gamma)) * total


def cdf(x: Column, dof: Column) -> Column:
    """P(chi-square of a whole ``dof`` <= x); 0 for x up to 0."""
    return F.when(x <= 0, 0.0).otherwise(_below(x, dof, _log_gamma_half(dof)))


def normal_quantile(p: float) -> float:
    """The standard normal quantile, by bisection of the error function."""
    low, high = -40.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (low, mid)
    return (low + high) / 2


def _newton(p: float, d: Column, log_gamma: Column) -> Callable[[Column, Column], Column]:
    def step(x: Column, _: Column) -> Column:
        slope = F.exp(_density_log(x, d, log_gamma)) * d / 2 / x
        return F.greatest(x - (_below(x, d, log_gamma) - p) / slope, x / 8)

    return step


def quantiles(rows: DataFrame, dof: str, shares: dict[str, float]) -> DataFrame:
    """``rows`` with a column per entry of ``shares``: the chi-square quantile for the whole number of degrees in ``dof``.

    Newton's method from the cube of a normal quantile; to 1e-8 of the value for shares from
    0.001 to 0.999.  Null for a dof below 1.
    """
    d = F.col(dof).cast("double")
    df = rows.withColumn("__lg", F.when(d >= 1, _log_gamma_half(d)))
    for name, p in shares.items():
        h = 2 / (9 * d)
        start = F.greatest(d * F.pow(1 - h + normal_quantile(p) * F.sqrt(h), F.lit(3.0)), F.lit(1e-3) * d)

        steps = F.sequence(F.lit(1), F.lit(NEWTON))
        df = df.withColumn(name, F.when(d >= 1, F.aggregate(steps, start, _newton(p, d, F.col("__lg")))))
    return df.drop("__lg")


def consistent(sums: DataFrame, total: str, dof: str, share: float = 0.95) -> DataFrame:
    """Add lower and upper, the two-sided ``share`` interval of a sum of squared normalised errors, and whether ``total`` is inside.

    The interval is made once for each number of degrees.
    """
    tail = (1 - share) / 2
    limits = quantiles(sums.select(dof).distinct(), dof, {"lower": tail, "upper": 1 - tail})
    return sums.join(limits, dof, "left").withColumn("inside", F.col(total).between(F.col("lower"), F.col("upper")))
