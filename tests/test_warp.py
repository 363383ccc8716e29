"""Alignment, warping and rendering against closed forms and plain loops."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import align, warp

DOWN = [1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, -1.0]  # x east, y south, looking down
CAMERA = warp.Camera(20.0, 20.0, 16.0, 16.0, 32, 32)


def flat(spark, z=0.0, n=40, lidar=1.0):
    ids = spark.range(-n, n)
    return ids.select(F.col("id").alias("r")).crossJoin(ids.select(F.col("id").alias("c"))).select("r", "c", F.lit(z).alias("z"), F.lit(lidar).alias("lidar"))


def frames(spark, *rows):
    return spark.createDataFrame([(i, *map(float, p), DOWN) for i, p in enumerate(rows)], "image long, cx double, cy double, cz double, rot array<double>")


def test_rays_meet_a_step(spark):
    """Down onto a plateau of 10 m for x >= 4, else flat ground; one ray goes up."""
    terrain = flat(spark).withColumn("z", F.when(F.col("c") >= 4, 10.0).otherwise(0.0))
    rays = [(0, 2.5, 0.5, 50.0, 0.0, 0.0, -1.0), (1, 6.5, 0.5, 50.0, 0.0, 0.0, -1.0), (2, 0.5, 0.5, 50.0, 0.6, 0.0, -0.8), (3, 0.5, 0.5, 50.0, 0.0, 0.0, 1.0), (4, 900.0, 0.5, 50.0, 0.0, 0.0, -1.0)]
    df = spark.createDataFrame(rays, "id long, ox double, oy double, oz double, dx double, dy double, dz double").withColumns({"near": F.lit(5.0), "far": F.lit(80.0)})
    got = {r["id"]: (r["s"], r["hit"]) for r in warp.march(df, ["id"], terrain, 1.0).collect()}
    assert got[0] == (pytest.approx(50, abs=0.05), True) and got[1] == (pytest.approx(40, abs=0.05), True) and got[2] == (pytest.approx(50, abs=0.05), True)
    assert got[3] == (80.0, False) and got[4] == (80.0, False)


def test_rendered_frame_comes_back(spark):
    """A ramp seen from above, rendered, rectified and warped: the ramp again, where the camera saw it."""
    terrain = flat(spark)
    scene = terrain.select("r", "c", (F.col("c") * 2.0 + F.col("r") + 100).alias("v"))
    at = frames(spark, (0.0, 0.0, 40.0))
    seen = warp.render(at, scene, terrain, 1.0, CAMERA, 1.0)
    px = {(r["r"], r["c"]): r["v"] for r in seen.collect()}
    assert len(px) == 32 * 32
    for (r, c), v in px.items():  # the ray's ground point, half way between cell centres
        east, north = (c + 0.5 - 16) * 2, -(r + 0.5 - 16) * 2
        assert v == pytest.approx((east - 0.5) * 2 + (north - 0.5) + 100, abs=0.6)
    back = {(r["r"], r["c"]): r for r in warp.rectify(at, seen, terrain, 1.0, CAMERA, 8, 2.0).collect()}
    for (r, c), row in back.items():
        east, north = (c - 4 + 0.5) * 2, -(r - 4 + 0.5) * 2
        # Sampled at floor(u): half a pixel, a metre here, from the centre that was rendered.
        assert row["confidence"] == 1.0 and row["v"] == pytest.approx((east + 1 - 0.5) * 2 + (north - 1 - 0.5) + 100, abs=1.2)
    laid, stats = warp.mosaic(frames(spark, (0.0, 0.0, 40.0), (4.0, 0.0, 40.0), (0.0, 0.0, 900.0)), seen.withColumn("image", F.lit(0)).union(seen.withColumn("image", F.lit(1))).union(seen.withColumn("image", F.lit(2))), terrain, 1.0, CAMERA, 8, 2.0, agl_max=200.0, rounds=1)
    assert {r["image"]: r["skipped"] for r in stats.collect()} == {0: False, 1: False, 2: True}
    assert all(r["lidar_share"] == 1.0 for r in stats.filter("NOT skipped").collect()) and laid.count() == 8 * 10


def test_confidence_tells_sources_apart(spark):
    """Filled heights count 64, measured ones 255; beyond the terrain and the image there is none."""
    terrain = flat(spark, n=6).withColumn("lidar", (F.col("c") >= 0).cast("double"))
    seen = flat(spark, n=40).select(F.lit(0).alias("image"), "r", "c", F.lit(5.0).alias("v")).filter("r >= 0 AND c >= 0 AND r < 32 AND c < 32")
    got = {(r["r"], r["c"]): r for r in warp.warp(frames(spark, (0.0, 0.0, 40.0)), seen, terrain, 1.0, CAMERA, 16, 1.0).collect()}
    for (_, c), r in got.items():
        east, north = r["east"], r["north"]
        over = -6 <= east < 6 and -6 <= north < 6
        assert r["confidence"] == ((255.0 if c >= 8 else 64.0) if over else 0.0)
    sparse = warp.warp(frames(spark, (0.0, 0.0, 40.0)), seen, terrain, 1.0, CAMERA, 16, 1.0, rounds=1, density=1.0).filter("confidence > 0").first()
    assert sparse["confidence"] < 255 * 0.3  # a quarter of a source pixel for each


def test_true_ortho_samples_the_scene(spark):
    scene = flat(spark).select("r", "c", (F.col("c") * 1.0).alias("v"))
    specs = spark.createDataFrame([(7, 0.0, 0.0, 0.0), (8, 0.0, 0.0, math.pi / 2)], "id long, gt_east double, gt_north double, gt_yaw double")
    got = {(r["id"], r["r"], r["c"]): r["v"] for r in warp.true_ortho(specs, scene, 4, 1.0, 1.0).collect()}
    for r in range(4):
        for c in range(4):
            assert got[7, r, c] == pytest.approx(c - 1.5 - 0.5) and got[8, r, c] == pytest.approx(-(1.5 - r) - 0.5)


def run_of(spark, pose, up=lambda t: 5 * math.sin(t / 7)):
    """An odometry track on a curve, and the same as the receiver's after ``pose``."""
    rows = [(t / 2, 6 * math.cos(t / 20) * t / 20, 6 * math.sin(t / 20) * t / 20, up(t)) for t in range(160)]
    odometry = spark.createDataFrame([("a", *r) for r in rows], "run_id string, t_s double, x double, y double, z double")
    turn, shift = pose
    seen = [("a", t, *map(float, turn @ np.array(p) + shift)) for t, *p in rows[::2]]
    return odometry, spark.createDataFrame(seen, "run_id string, t_s double, east double, north double, up double")


def test_windows_find_the_pose(spark):
    turn, shift = align.turn_about(np.array([0.0, 0.6, 0.8]), 0.7), np.array([100.0, -40.0, 12.0])
    odometry, receiver = run_of(spark, (turn, shift))
    nodes = align.windowed_series(odometry, receiver).cache()
    for r in nodes.collect():
        assert np.allclose(np.reshape(r["rotation"], (3, 3)), turn, atol=1e-6) and np.allclose(r["translation"], shift, atol=1e-5) and r["n"] >= 8
    got = {r["t_s"]: (r["east"], r["north"], r["up"]) for r in align.placed(odometry, nodes).collect()}
    want = {r["t_s"]: (r["east"], r["north"], r["up"]) for r in receiver.collect()}
    assert all(np.allclose(got[t], want[t], atol=1e-4) for t in want)
    lifted = align.placed(odometry, align.shifted_up(nodes, 6.6)).filter("t_s = 4").first()
    assert lifted["up"] == pytest.approx(want[4.0][2] + 6.6, abs=1e-4)
    down = align.placed(odometry, nodes, mirror=True).filter("t_s = 4").first()
    assert down["up"] == pytest.approx(-want[4.0][2], abs=1e-4) and down["east"] == pytest.approx(want[4.0][0], abs=1e-4)


def test_straight_windows_keep_the_turn(spark):
    """On a line the turn about it is not seen; it is the one of the window before."""
    turn, shift = align.turn_about(np.array([0.0, 0.0, 1.0]), 0.4), np.zeros(3)
    bent = [(t / 2, 3 * math.cos(t / 6), 3 * math.sin(t / 6), 2 * math.sin(t / 5)) for t in range(30)]
    rows = bent + [(15 + t / 2, 3 + t, 0.0, 0.0) for t in range(60)]
    odometry = spark.createDataFrame([("a", *map(float, r)) for r in rows], "run_id string, t_s double, x double, y double, z double")
    receiver = spark.createDataFrame([("a", float(t), *map(float, turn @ np.array(p) + shift)) for t, *p in rows], "run_id string, t_s double, east double, north double, up double")
    nodes = {r["window"]: r for r in align.windowed_series(odometry, receiver, sigma_m=0.3).collect()}
    assert any(r["held"] for r in nodes.values())
    assert all(np.allclose(np.reshape(r["rotation"], (3, 3)), turn, atol=1e-5) for r in nodes.values() if r["held"])


def test_up_comes_from_the_clouds(spark):
    odometry = spark.createDataFrame([("a", float(t), float(t), 0.0, 0.0) for t in range(10)], "run_id string, t_s double, x double, y double, z double")
    clouds = spark.createDataFrame([("a", k, float(k), float(k), float(j), h) for k in range(8) for j in range(5) for h in ([-20.0] if k < 5 else [90.0])], "run_id string, cloud long, t_s double, x double, y double, z double")
    for axis in (1.0, -1.0):
        up = align.up_from_clouds(clouds, odometry, spark.createDataFrame([("a", [0.0, 0.0, axis])], "run_id string, up array<double>")).first()["up"]
        assert up[2] == 1.0
    nodes = spark.createDataFrame([("a", 0.0, DOWN, [1.0, 2.0, 3.0])], "run_id string, t_s double, rotation array<double>, translation array<double>")
    turned = align.upright(nodes, spark.createDataFrame([("a", [0.0, 0.0, 1.0])], "run_id string, up array<double>")).first()
    assert turned["rotation"][8] == 1.0 and turned["translation"] == [1.0, 2.0, -3.0]


def test_velocity_frames(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    got = {f: df.select(*align.velocity_en(f, F.col("x"), F.col("y"))).first() for f in ("ned", "enu")}
    assert tuple(got["ned"]) == (2.0, 1.0) and tuple(got["enu"]) == (1.0, 2.0)
    with pytest.raises(ValueError, match="frame"):
        align.velocity_en("up", F.col("x"), F.col("y"))
    assert df.select(align.ratio_ok(F.lit(0.9995), 0.02), align.ratio_ok(F.lit(1.2278), 0.02)).first()[:] == (True, False)


def test_banded_solver():
    rng = np.random.default_rng(1)
    n = 7
    a = rng.normal(size=(n, 3, 3))
    diagonal = np.einsum("nij,nkj->nik", a, a) + 9 * np.eye(3)
    beside, right = rng.normal(size=(n - 1, 3, 3)), rng.normal(size=(n, 3))
    whole = np.zeros((3 * n, 3 * n))
    for i in range(n):
        whole[3 * i : 3 * i + 3, 3 * i : 3 * i + 3] = diagonal[i]
        if i < n - 1:
            whole[3 * i : 3 * i + 3, 3 * i + 3 : 3 * i + 6] = beside[i]
            whole[3 * i + 3 : 3 * i + 6, 3 * i : 3 * i + 3] = beside[i].T
    assert np.allclose(align.solve_tridiagonal(diagonal, beside, right).ravel(), np.linalg.solve(whole, right.ravel()))
