"""Streams that act on time without input: look-ahead prefetch and operating modes by timers.

Both keep one row of state a key, with a time to live, in processing time.  They need the
RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).  ``prefetch_ticks`` is
the batch twin of the first over recorded requests; ``stateful.mode_step`` of the second.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Less movement than this (m/s) has nothing ahead, and requests closer in time (s) give no velocity.
STILL, SOON = 1e-3, 1e-3


class _Timed(StatefulProcessor):
    """One value a key and one timer that is set anew."""

    SCHEMA = ""

    def __init__(self, ttl_s: float) -> None:
        self.ttl_ms = int(ttl_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.SCHEMA, self.ttl_ms)

    def wake(self, *at_ms: int) -> None:
        """Only these timers remain."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        for t in at_ms:
            self.handle.registerTimer(t)

    def close(self) -> None:
        pass


class Prefetcher(_Timed):
    """Requests (t in seconds, east, north) in; every ``period_s`` the place ahead and its radius out, input or not.

    A key is forgotten ``ttl_s`` after its last request.
    """

    SCHEMA = "t double, east double, north double, ve double, vn double"

    def __init__(self, period_s: float, lookahead_s: float, ttl_s: float) -> None:
        super().__init__(ttl_s)
        self.period_ms, self.lookahead_s = int(period_s * 1000), lookahead_s

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.state.get() if self.state.exists() else None
        for r in pd.concat(list(rows)).sort_values("t", kind="stable").itertuples(index=False):
            ve, vn = (held[3], held[4]) if held else (0.0, 0.0)
            if held and r.t - held[0] > SOON:
                ve, vn = (r.east - held[1]) / (r.t - held[0]), (r.north - held[2]) / (r.t - held[0])
            held = (float(r.t), float(r.east), float(r.north), ve, vn)
        self.state.update(held)
        now = timerValues.getCurrentProcessingTimeInMs()
        if not list(self.handle.listTimers()):
            self.wake((now // self.period_ms + 1) * self.period_ms)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.state.exists():
            return  # past its time to live: no more ticks
        _, east, north, ve, vn = self.state.get()
        now, speed = timerValues.getCurrentProcessingTimeInMs(), math.hypot(ve, vn)
        self.wake((now // self.period_ms + 1) * self.period_ms)
        if speed >= STILL:
            a = self.lookahead_s
            yield pd.DataFrame({"run_id": [key[0]], "tick_ms": [expiredTimerInfo.getExpiryTimeInMs()], "east": [east + ve * a], "north": [north + vn * a], "radius_m": [2 * a * speed]})


def prefetch(requests: DataFrame, period_s: float = 1.0, lookahead_s: float = 2.0, ttl_s: float = 60.0) -> DataFrame:
    """A stream of prefetches (run_id, tick_ms, east, north, radius_m) from one of requests (run_id, t, east, north)."""
    kind = dict(requests.dtypes)["run_id"]
    schema = f"run_id {kind}, tick_ms long, east double, north double, radius_m double"
    return requests.groupBy("run_id").transformWithStateInPandas(Prefetcher(period_s, lookahead_s, ttl_s), schema, "Append", "ProcessingTime")


def prefetch_ticks(requests: DataFrame, period_s: float, lookahead_s: float, ttl_s: float) -> DataFrame:
    """The prefetches of recorded requests (run_id, ord, t, east, north), had ticks come at every multiple of ``period_s``.

    A tick uses the last request at or before it and the velocity between that and the one
    before, unless these are too close; ticks end ``ttl_s`` after a request.
    """
    w = W.partitionBy("run_id").orderBy("t", "ord")
    dt = F.col("t") - F.lag("t").over(w)
    speed = {f"v{a}": F.when(dt > SOON, (F.col(c) - F.lag(c).over(w)) / dt) for a, c in (("e", "east"), ("n", "north"))}
    df = requests.withColumns({**speed, "next": F.lead("t").over(w)})
    df = df.withColumns({v: F.coalesce(F.last(v, ignorenulls=True).over(w), F.lit(0.0)) for v in speed})
    first, end = F.ceil(F.col("t") / period_s), F.least(F.ceil(F.col("next") / period_s) - 1, F.floor((F.col("t") + ttl_s) / period_s))
    df = df.withColumns({"__a": first, "__b": end, "__v": F.sqrt(F.col("ve") * F.col("ve") + F.col("vn") * F.col("vn"))}).filter((F.col("__a") <= F.col("__b")) & (F.col("__v") >= STILL))
    ticks = df.withColumn("tick", F.explode(F.sequence("__a", "__b")))
    ahead = [(F.col(c) + F.col(v) * lookahead_s).alias(c) for c, v in (("east", "ve"), ("north", "vn"))]
    return ticks.select("run_id", (F.col("tick") * period_s).alias("tick_s"), *ahead, (2 * lookahead_s * F.col("__v")).alias("radius_m"))


class Modes(_Timed):
    """Fixes (t, value) in; a row at every change of mode out, those that come from silence too.

    A fix up to ``good`` makes the mode nominal (recovery after coasting or lost), a worse one
    leaves or degrades it; ``coast_s`` after the last good fix the mode is coasting, ``lost_s``
    after it lost, by timer.
    """

    SCHEMA = "mode string, good_ms long"

    def __init__(self, good: float, coast_s: float, lost_s: float, hysteresis: float, ttl_s: float) -> None:
        super().__init__(ttl_s)
        self.good, self.coast_ms, self.lost_ms, self.hysteresis = good, int(coast_s * 1000), int(lost_s * 1000), hysteresis

    def _row(self, key, at_ms: int, mode: str) -> pd.DataFrame:
        return pd.DataFrame({"run_id": [key[0]], "at_ms": [at_ms], "mode": [mode]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mode, good_ms = self.state.get() if self.state.exists() else ("init", -1)
        now, out = timerValues.getCurrentProcessingTimeInMs(), []
        for r in pd.concat(list(rows)).sort_values("t", kind="stable").itertuples(index=False):
            before = mode
            if r.value <= self.good:
                mode, good_ms = ("recovery" if mode in ("coasting", "lost") else "nominal"), now
            elif mode == "recovery" or (mode == "nominal" and r.value > self.good * self.hysteresis):
                mode = "degraded"
            if mode != before:
                out.append(self._row(key, now, mode))
        self.state.update((mode, good_ms))
        if good_ms == now:
            self.wake(now + self.coast_ms, now + self.lost_ms)
        yield pd.concat(out) if out else pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.state.exists():
            return
        mode, good_ms = self.state.get()
        at = expiredTimerInfo.getExpiryTimeInMs()
        new = "lost" if at - good_ms >= self.lost_ms else "coasting"
        if new != mode:
            self.state.update((new, good_ms))
            yield self._row(key, at, new)


def modes(fixes: DataFrame, good: float = 20.0, coast_s: float = 20.0, lost_s: float = 180.0, hysteresis: float = 1.25, ttl_s: float = 3600.0) -> DataFrame:
    """A stream of mode changes (run_id, at_ms, mode) from one of fixes (run_id, t, value)."""
    kind = dict(fixes.dtypes)["run_id"]
    return fixes.groupBy("run_id").transformWithStateInPandas(Modes(good, coast_s, lost_s, hysteresis, ttl_s), f"run_id {kind}, at_ms long, mode string", "Append", "ProcessingTime")
