"""Exact quantiles of large groups, in two passes with bounded memory a group.

A sketch gives for each wanted quantile two values that have it between them; then the rows
below are counted and only those between, a small share, are put in order.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rank error of the sketch is at most one in so many rows.
ACCURACY = 10_000
#: Tasks that may share a group's rows, where there may be many groups.
SALTS = 32


def same_keys(a: DataFrame, b: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Join on ``by`` with null equal to null; the keys of ``a`` are kept."""
    if not by:
        a, b = a.withColumn("__one", F.lit(1)), b.withColumn("__one", F.lit(1))
        return a.join(b, "__one", how).drop("__one")
    b = b.withColumnsRenamed({k: f"__{k}" for k in by})
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in by]
    return a.join(b, on, how).drop(*(f"__{k}" for k in by))


class Wanted:
    """Quantiles by name: which columns they are of, and what a first pass must aggregate to bound them."""

    def __init__(self, wanted: dict[str, tuple[Column, float]]) -> None:
        self.columns: dict[str, Column] = {}
        self.names: dict[str, list[tuple[str, float]]] = {}
        for name, (value, q) in wanted.items():
            alias = next((a for a, c in self.columns.items() if str(c) == str(value)), f"__v{len(self.columns)}")
            self.columns[alias] = value
            self.names.setdefault(alias, []).append((name, q))

    def values(self) -> list[Column]:
        return [c.cast("double").alias(a) for a, c in self.columns.items()]

    def ends(self) -> list[Column]:
        """Aggregates: count, least, greatest and for each quantile two values of the sketch about it."""
        out, slack = [], 3.0 / ACCURACY
        for a, asked in self.names.items():
            cuts = [c for _, q in asked for c in (max(0.0, q - slack), min(1.0, q + slack))]
            out += [F.count(a).alias(f"{a}n"), F.min(a).alias(f"{a}l"), F.max(a).alias(f"{a}h"), F.percentile_approx(a, cuts, ACCURACY).alias(f"{a}b")]
        return out

    def settle(self, rows: DataFrame, bounds: DataFrame, by: list[str], few: bool) -> DataFrame:
        """The quantiles of ``rows`` (by, values) from ``bounds`` (by, ends): rows below are counted, those between put in order."""
        ends, at, names = [], {}, []
        for a, asked in self.names.items():
            n = F.col(f"{a}n")
            for i, (name, q) in enumerate(asked):
                small = n < 2 * ACCURACY  # the sketch's error is less than a few rows there
                ends += [F.when(small, F.col(f"{a}l")).otherwise(F.col(f"{a}b")[2 * i]).alias(f"__lo_{name}"), F.when(small, F.col(f"{a}h")).otherwise(F.col(f"{a}b")[2 * i + 1]).alias(f"__hi_{name}")]
                at[name] = F.lit(q) * (n - 1)
                names.append((name, a))
        limits = bounds.select(*by, *ends, *(f"{a}n" for a in self.columns))
        if few or not by:
            met = same_keys(rows, F.broadcast(limits), by)
        else:  # a group's rows go to many tasks, so that none has a large group whole
            salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*self.columns), F.lit(SALTS)))
            met = same_keys(salted, limits.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), [*by, "__salt"]).drop("__salt")
        below = met.groupBy(*by).agg(*(F.any_value(f"{a}n").alias(f"{a}n") for a in self.columns), *(F.count_if(F.col(a) < F.col(f"__lo_{name}")).alias(f"__below_{name}") for name, a in names))
        within = {name: (F.col(a) >= F.col(f"__lo_{name}")) & (F.col(a) <= F.col(f"__hi_{name}")) for name, a in names}
        inside = F.array_compact(F.array(*(F.when(within[name], F.struct(F.lit(name).alias("name"), F.col(a).alias("v"))) for name, a in names)))
        counts = met.filter(reduce(or_, within.values())).select(*by, F.explode(inside).alias("x")).groupBy(*by, "x.name", "x.v").agg(F.count("*").alias("n"))
        asked = below.select(*by, F.explode(F.array(*(F.struct(F.lit(name).alias("name"), at[name].alias("at"), F.col(f"__below_{name}").alias("below")) for name, _ in names))).alias("x")).select(*by, "x.*")
        ranked = same_keys(counts, F.broadcast(asked) if few or not by else asked, [*by, "name"])
        upto = F.col("below") + F.sum("n").over(W.partitionBy(*by, "name").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow))
        ranked = ranked.withColumn("upto", upto)
        low, high = (F.min(F.when(F.col("upto") > f(F.col("at")), F.col("v"))) for f in (F.floor, F.ceil))
        found = ranked.groupBy(*by, "name").agg(low.alias("low"), high.alias("high"), F.first("at").alias("at"))
        value = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at")))
        wide = found.withColumn("value", value).groupBy(*by).agg(*(F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name, _ in names))
        return same_keys(bounds.select(*by), F.broadcast(wide) if few else wide, by, "left") if by else wide


def exact_quantiles(df: DataFrame, by: list[str], wanted: dict[str, tuple[Column, float]], few: bool = False) -> DataFrame:
    """``by`` and a column per entry of ``wanted`` (value, quantile): linear between ranks, nulls left out.

    NaN counts as greater than all numbers.  A group without a value has null.  With ``few``
    groups, as of a fixed list, a row each goes to all tasks and the rows themselves stay.
    """
    asked = Wanted(wanted)
    rows = df.select(*by, *asked.values())
    return asked.settle(rows, rows.groupBy(*by).agg(F.count("*").alias("__rows"), *asked.ends()), by, few)
