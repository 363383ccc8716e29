"""Stateful streams: acceptance gates, operating modes, a cache of recent centres.

Event time is sensor time.  Each operator keeps a bounded state per key and has a batch twin
that folds the same step over a key's rows in order.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A step takes (state, row) to (state, output); state is a flat tuple.
Step = Callable[[tuple, Any], tuple[tuple, tuple]]


def consistency_step(size: int = 5, limit_m: float = 25.0) -> tuple[Step, tuple]:
    """Accept a candidate if it is near the last accepted one, or if ``size`` rejected ones in a row agree.

    State: last accepted value, run of rejected ones, their least and greatest value.
    """

    def step(state: tuple, row: Any) -> tuple[tuple, tuple]:
        last, run, lo, hi = state
        v = float(row.value)
        if math.isnan(last) or abs(v - last) <= limit_m:
            return (v, 0, 0.0, 0.0), (True, 0)
        lo, hi = (min(lo, v), max(hi, v)) if run else (v, v)
        if hi - lo > limit_m:
            lo, hi, run = v, v, 0
        run += 1
        if run >= size:
            return (v, 0, 0.0, 0.0), (True, run)
        return (last, run, lo, hi), (False, run)

    return step, (float("nan"), 0, 0.0, 0.0)


MODES = ("init", "nominal", "degraded", "coasting", "recovery", "lost")


def mode_step(good: float = 20.0, coast_s: float = 20.0, lost_s: float = 180.0, hysteresis: float = 1.25) -> tuple[Step, tuple]:
    """Operating mode from the quality of fixes and the time since the last good one.

    Entering a worse mode needs the error above ``good`` times ``hysteresis``, leaving it
    below ``good``.  State: mode, time of the last good fix.
    """

    def step(state: tuple, row: Any) -> tuple[tuple, tuple]:
        mode, since = state
        t, v = float(row.t), float(row.value)
        quiet = 0.0 if math.isnan(since) else t - since
        if v <= good:
            mode = "recovery" if mode in ("coasting", "lost") else "nominal"
            since = t
        elif quiet > lost_s:
            mode = "lost"
        elif quiet > coast_s:
            mode = "coasting"
        elif mode == "nominal" and v > good * hysteresis:
            mode = "degraded"
        elif mode == "recovery":
            mode = "degraded"
        return (mode, since), (mode, quiet)

    return step, ("init", float("nan"))


def cache_step(radius: float = 100.0, share: float = 0.3) -> tuple[Step, tuple]:
    """Whether a request hits the cached centre: moved by at most ``share`` of the window; else it is stored anew."""

    def step(state: tuple, row: Any) -> tuple[tuple, tuple]:
        centre, misses = state
        v = float(row.value)
        if not math.isnan(centre) and abs(v - centre) <= share * 2 * radius:
            return state, (True, misses)
        return (v, misses + 1), (False, misses + 1)

    return step, (float("nan"), 0)


def descriptor_step(share: float = 0.3, by_model: bool = True) -> tuple[Step, tuple]:
    """Whether a request (east, north, radius_m, gsd, model) is served by the descriptors kept: same gsd, same model, moved by at most ``share`` of its window.

    Else its own are kept.  State: east, north, gsd, model of those kept, and how often any were made.
    """

    def step(state: tuple, row: Any) -> tuple[tuple, tuple]:
        east, north, gsd, model, made = state
        near = made > 0 and math.hypot(row.east - east, row.north - north) <= share * 2 * row.radius_m
        if near and row.gsd == gsd and (row.model == model or not by_model):
            return state, (True, made)
        return (float(row.east), float(row.north), float(row.gsd), row.model, made + 1), (False, made + 1)

    return step, (0.0, 0.0, 0.0, "", 0)


def batch_twin(rows: DataFrame, made: tuple[Step, tuple], output: str, key: str = "run_id") -> DataFrame:
    """The step folded over each key's rows (key, ord, t, value) in order.

    Rows come sorted by key and order and pass batch by batch; only the state is kept.
    """
    step, first = made
    names = [c.strip().split()[0] for c in output.split(",")]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, at, begun = first, None, False
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                k = getattr(row, key)
                k = None if pd.isna(k) else k
                if not begun or k != at:
                    state, at, begun = first, k, True
                state, made_row = step(state, row)
                out.append((k, row.ord, *made_row))
            yield pd.DataFrame(out, columns=[key, "ord", *names])

    kind = dict(rows.dtypes)[key]
    return rows.repartition(key).sortWithinPartitions(key, "ord").mapInPandas(fold, f"{key} {kind}, ord long, {output}")


def stream(rows: DataFrame, made: tuple[Step, tuple], state: str, output: str, key: str = "run_id") -> DataFrame:
    """The step as a streaming operator; rows of a trigger are taken in order."""
    step, first = made
    names = [c.strip().split()[0] for c in output.split(",")]

    def fold(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(held.get) if held.exists else first
        out = []
        for row in pd.concat(list(batches)).sort_values("ord", kind="stable").itertuples(index=False):
            now, made_row = step(now, row)
            out.append((k[0], row.ord, *made_row))
        held.update(now)
        yield pd.DataFrame(out, columns=[key, "ord", *names])

    kind = dict(rows.dtypes)[key]
    return rows.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, ord long, {output}", state, "append", GroupStateTimeout.NoTimeout)


def windowed_rates(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and latency figures per stage and event-time window, with a watermark; batch or stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("top")).select(F.col("w.start").alias("start"), "event_type", "n", "mean", "top")
