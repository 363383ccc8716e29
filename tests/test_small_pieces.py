"""Sinks, readers and terrain helpers that no query reaches."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import geodesy, rotation
from plumbline.operators import maps, warp, windows
from plumbline.sources import records


def test_trend_store_grows(spark, tmp_path):
    store = f"{tmp_path}/trend"
    records.append_trend(spark.createDataFrame([("a", 0.5)], "run_id string, a_at_20 double"), store)
    records.append_trend(spark.createDataFrame([("b", 0.6, 0.01)], "run_id string, a_at_20 double, ifr double"), store)
    assert {tuple(r) for r in records.read_trend(spark, store).select("run_id", "a_at_20", "ifr").collect()} == {("a", 0.5, None), ("b", 0.6, 0.01)}


def test_raw_images(spark, tmp_path):
    v = np.arange(12, dtype="<f8").reshape(3, 4)
    (tmp_path / "x.raw").write_bytes(v.tobytes())
    got = {(r["r"], r["c"]): r["v"] for r in records.read_raw_images(spark, str(tmp_path / "x.raw"), 3, 4).collect()}
    assert got == {(r, c): v[r, c] for r in range(3) for c in range(4)}
    with pytest.raises(Exception, match="has 12 values"):
        records.read_raw_images(spark, str(tmp_path / "x.raw"), 5, 5).collect()


def test_edges_between_tiles(spark):
    df = spark.createDataFrame([(3, 5, 4, 5, 4), (3, 5, 3, 6, 4)], "x long, y long, x2 long, y2 long, z int")
    z = F.col("z")
    edge = maps.shared_edge(F.col("x"), F.col("y"), F.col("x2"), F.col("y2"), z).alias("e")
    rows = df.select("x2", edge, geodesy.tile_bounds(F.col("x"), F.col("y"), z).alias("a"), geodesy.tile_bounds(F.col("x2"), F.col("y2"), z).alias("b")).collect()
    for r in rows:
        e, a, b = r["e"], r["a"], r["b"]
        if r["x2"] == 4:
            assert (e["x1"], e["x2"], e["y1"], e["y2"]) == (a["east"], a["east"], a["north"], a["south"]) and a["east"] == pytest.approx(b["west"])
        else:
            assert (e["x1"], e["x2"]) == (a["west"], a["east"]) and e["y1"] == e["y2"] == pytest.approx(a["south"]) and e["y1"] == b["north"]


def test_bounds_of_corners(spark):
    box = spark.createDataFrame([(38.5, 55.0, 39.5, 56.0)], "west double, south double, east double, north double")
    got = windows.bounds_of(box, 37).first()
    corners = [spark.range(1).select(geodesy.utm(F.lit(math.radians(a)), F.lit(math.radians(o)), 37).alias("u")).first()["u"] for a in (55.0, 56.0) for o in (38.5, 39.5)]
    east, north = [u["easting"] for u in corners], [u["northing"] for u in corners]
    assert (got["east_min"], got["east_max"], got["north_min"], got["north_max"]) == (min(east), max(east), min(north), max(north))


def test_buildings_and_lidar_hits(spark):
    ground = spark.range(64 * 64).select(F.floor(F.col("id") / 64).alias("r"), (F.col("id") % 64).alias("c"), F.lit(2.0).alias("z"), F.lit(1.0).alias("lidar"))
    roof = ground.filter("r BETWEEN 40 AND 50 AND c BETWEEN 40 AND 50").select("r", "c")
    terrain = warp.raised(ground, roof.union(roof), 12.0)
    assert {r["z"]: r["count"] for r in terrain.groupBy("z").count().collect()} == {2.0: 64 * 64 - 121, 14.0: 121}
    rays = spark.createDataFrame([(0, 10.5, 10.5, 30.0, 0.0, 0.0, -1.0), (1, 45.5, 45.5, 30.0, 0.0, 0.0, -1.0), (2, 10.5, 10.5, 30.0, 0.0, 0.0, 1.0), (3, 2.5, 45.5, 10.0, 1.0, 0.0, 0.0)], "id long, ox double, oy double, oz double, dx double, dy double, dz double").withColumns({"near": F.lit(1.0), "far": F.lit(60.0)})
    got = {r["id"]: (r["x"], r["y"], r["z"]) for r in warp.lidar_hits(rays, ["id"], terrain, 1.0).collect()}
    assert set(got) == {0, 1, 3}
    assert got[0] == pytest.approx((10.5, 10.5, 2.0), abs=0.01) and got[1] == pytest.approx((45.5, 45.5, 14.0), abs=0.01) and got[3] == pytest.approx((40.0, 45.5, 10.0), abs=0.01)


def test_heading_matrix(spark):
    m = spark.range(1).select(rotation.heading2(F.lit(0.3)).alias("m"), rotation.heading2_rate(F.lit(0.3)).alias("d")).first()
    assert m["m"] == pytest.approx([math.cos(0.3), -math.sin(0.3), math.sin(0.3), math.cos(0.3)]) and m["d"] == pytest.approx([-math.sin(0.3), -math.cos(0.3), math.cos(0.3), -math.sin(0.3)])
