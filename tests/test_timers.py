"""Timers that fire without input, on small streams; recorded ticks by a plain loop."""

from __future__ import annotations

import math
import time

import pytest

from plumbline.streaming import timers

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    yield spark
    spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def run(spark, made, name, folder, done):
    """Start a query into memory and wait until ``done`` of its rows holds."""
    query = made.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", folder).trigger(processingTime="200 milliseconds").start()
    try:
        end = time.time() + 90
        while time.time() < end:
            rows = spark.table(name).collect()
            if done(rows):
                return rows
            if query.exception():
                raise AssertionError(str(query.exception()))
            time.sleep(0.3)
        raise AssertionError(f"not in time: {rows}")
    finally:
        query.stop()


def test_a_tick_without_input_prefetches(rocks, tmp_path):
    rows = [("a", 0.0, 0.0, 0.0), ("a", 1.0, 3.0, 4.0), ("still", 0.0, 1.0, 1.0), ("still", 1.0, 1.0, 1.0)]
    rocks.createDataFrame(rows, "run_id string, t double, east double, north double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = rocks.readStream.schema("run_id string, t double, east double, north double").parquet(str(tmp_path / "in"))
    got = run(rocks, timers.prefetch(stream, period_s=0.5, lookahead_s=2.0), "ticks", str(tmp_path / "state"), lambda r: len(r) >= 3)
    assert {r["run_id"] for r in got} == {"a"} and len({r["tick_ms"] for r in got}) >= 3  # one file, several ticks
    assert all((r["east"], r["north"], r["radius_m"]) == (9.0, 12.0, 20.0) and r["tick_ms"] % 500 == 0 for r in got)


def test_silence_changes_the_mode(rocks, tmp_path):
    rocks.createDataFrame([("a", 1.0, 5.0), ("b", 1.0, 99.0)], "run_id string, t double, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = rocks.readStream.schema("run_id string, t double, value double").parquet(str(tmp_path / "in"))
    got = run(rocks, timers.modes(stream, coast_s=0.6, lost_s=1.5), "modes", str(tmp_path / "state"), lambda r: any(x["mode"] == "lost" for x in r))
    got = sorted(got, key=lambda r: r["at_ms"])
    assert [(r["run_id"], r["mode"]) for r in got] == [("a", "nominal"), ("a", "coasting"), ("a", "lost")]
    assert got[1]["at_ms"] - got[0]["at_ms"] == 600 and got[2]["at_ms"] - got[0]["at_ms"] == 1500


def test_recorded_ticks(spark):
    rows = [("a", i, t, 3.0 * t, math.sin(t)) for i, t in enumerate([0.4, 1.1, 1.1, 5.0, 30.0, 31.0])] + [("b", 9, 1.0, 0.0, 0.0)]
    made = timers.prefetch_ticks(spark.createDataFrame(rows, "run_id string, ord long, t double, east double, north double"), 1.0, 2.0, 10.0)
    want, mine = [], [r for r in rows if r[0] == "a"]
    for tick in range(60):
        past = [r for r in mine if r[2] <= tick]
        if len(past) < 2 or tick - past[-1][2] > 10:
            continue
        v = next(((b[3] - a[3]) / (b[2] - a[2]), (b[4] - a[4]) / (b[2] - a[2])) for a, b in zip(past[-2::-1], past[:0:-1], strict=True) if b[2] - a[2] > 1e-3)
        want.append((float(tick), past[-1][3] + 2 * v[0], past[-1][4] + 2 * v[1], 4 * math.hypot(*v)))
    got = sorted((r["tick_s"], r["east"], r["north"], r["radius_m"]) for r in made.collect())
    assert len(got) == len(want) and all(a == pytest.approx(b) for a, b in zip(got, want, strict=True))
