"""Steps whose work or memory once grew faster than their input."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import align, grids, kernels, maps, ordered, outages, warp
from plumbline.operators.quantiles import exact_quantiles

EDGES = "ring int, x1 double, y1 double, x2 double, y2 double"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_thick_runs_are_the_cells_and_disjoint(spark):
    rng = random.Random(3)
    at = lambda: rng.choice([rng.uniform(-9, 9), float(rng.randint(-9, 9)), rng.randint(-18, 18) / 2])
    rows = [(i % 9, at(), at(), at(), at()) for i in range(60)] + [(9, 2.0, 2.0, 2.0, 2.0), (9, 0.0, 1.5, 6.0, 1.5), (9, None, 0.0, 1.0, 1.0)]
    segments = spark.createDataFrame(rows, EDGES.replace("ring", "line"))

    def near(x1, y1, x2, y2, r, c):
        size = (x2 - x1) ** 2 + (y2 - y1) ** 2
        t = 0.0 if size == 0 else min(max(((c - x1) * (x2 - x1) + (r - y1) * (y2 - y1)) / size, 0.0), 1.0)
        return ((c - x1) - t * (x2 - x1)) ** 2 + ((r - y1) - t * (y2 - y1)) ** 2 <= 2.25

    want = {(k, r, c) for k, *e in rows if None not in e for r in range(-12, 13) for c in range(-12, 13) if near(*e, r, c)}
    got = [(x["line"], x["r"], x["c"]) for x in grids.thick_lines(segments, 1.5).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    counts = {x["line"]: x["cells"] for x in grids.thick_cells(segments, 1.5).collect()}
    assert counts == {k: sum(w[0] == k for w in want) for k in {w[0] for w in want}}


def test_thick_lines_shuffle_segments_and_no_cells(spark):
    segments = spark.createDataFrame([(1, 0.0, 0.0, 5.0, 5.0)], EDGES.replace("ring", "line"))
    assert plan(grids.thick_lines(segments, 1.5)).count("Exchange") == 1


def test_polygon_crossings_are_shuffled_once_by_ring(spark):
    square = [(1, 0.0, 0.0, 0.0, 4.0), (1, 0.0, 4.0, 4.0, 4.0), (1, 4.0, 4.0, 4.0, 0.0), (1, 4.0, 0.0, 0.0, 0.0)]
    edges = spark.createDataFrame(square, EDGES)
    for made in (grids.polygon_mask(edges), grids.polygon_cells(edges), grids.polygon_mask(edges, 3, 3)):
        text = plan(made)
        assert text.count("Exchange") == 1 and "hashpartitioning(ring" in text and "keys=[ring#" in text
        assert not any("r#" in line.split("functions")[0] for line in text.splitlines() if "Aggregate(" in line)
    assert grids.polygon_mask(edges, 3, 3).count() == 9


def test_an_open_line_leaves_its_last_crossing_of_a_row_out(spark):
    rows = [(1, 1.0, 0.0, 1.0, 3.0), (1, 4.0, 0.0, 4.0, 3.0), (1, 9.0, 1.0, 9.0, 2.0), (2, -3.0, -2.0, -3.0, 1.0), (2, 2.0, -2.0, 2.0, 1.0), (2, None, 0.0, 1.0, 1.0)]
    got = sorted(tuple(r) for r in grids.polygon_runs(spark.createDataFrame(rows, EDGES)).select("ring", "r", "c0", "c1").collect())
    assert got == [(1, 0, 1, 4), (1, 1, 1, 4), (1, 2, 1, 4), (2, -2, -3, 2), (2, -1, -3, 2), (2, 0, -3, 2)]


def test_window_sums_hold_a_part_of_the_plane_at_a_time(spark):
    cells = spark.range(40).selectExpr("id * 1000003 AS r", "id * 7 - 90 AS c", "CAST(id % 3 AS INT) AS class")
    got = grids.window_fractions(cells.selectExpr("r AS id", "r", "c"), cells, 4, 3)
    assert "Window" not in plan(got)
    assert [r["n"] for r in got.collect()] == [1] * 40  # their rectangle has ten thousand million places
    assert grids.window_fractions(cells.select(F.col("r").alias("id"), "r", "c"), cells, 4, 3).count() == 40


def test_all_shifts_are_compared_in_one_pass(spark):
    a = spark.range(400).selectExpr("id div 20 - 10 AS r", "id % 20 + 120 AS c", "id * id % 97 AS v")
    b = a.selectExpr("r + 2 AS r", "c - 1 AS c", "v")
    found = grids.windowed_offset(a, b, 3, 4, 2)
    assert plan(found).count("Exchange hash") == 2
    got = found.collect()
    assert len(got) >= 9 and {(x["dr"], x["dc"]) for x in got} == {(-2, 1)} and all(x["ncc"] == pytest.approx(1.0) for x in got)


def test_edges_of_lines_cover_cells_once_without_shuffling_them(spark):
    rows = [(1, -1.5, 0.0, 4.2, 3.0), (1, 4.2, 3.0, 4.2, 3.0), (2, 7.0, -2.5, 0.0, -2.5)]
    made = maps.edge_cells(spark.createDataFrame(rows, EDGES.replace("ring", "line")))
    want = set()
    for line, x1, y1, x2, y2 in rows:
        n = max(1, math.ceil(max(abs(x2 - x1), abs(y2 - y1))))
        want |= {(line, math.floor(y1 + k / n * (y2 - y1)) + i, math.floor(x1 + k / n * (x2 - x1)) + j) for k in range(n + 1) for i in (-1, 0, 1) for j in (-1, 0, 1)}
    assert plan(made).count("Exchange") == 1
    got = [(x["line"], x["r"], x["c"]) for x in made.collect()]
    assert len(got) == len(want) and set(got) == want


def test_runs_in_blocks_look_back_as_whole_ones(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.choice("aab"), rng.choice([i, i // 9]), rng.random() < 0.7, rng.random()) for i in range(400)] + [("c", 1, True, 0.5), (None, 1, True, 0.5), (None, 2, True, 0.1)]
    track = spark.createDataFrame(rows, "run_id string, ord long, coasting boolean, sigma double")
    whole = sorted(map(tuple, outages.growing_covariance(track).collect()), key=repr)
    fixes = track.groupBy("run_id", "ord").agg(F.max("sigma").alias("est_east")).selectExpr("run_id", "ord", "true AS accepted", "est_east", "-est_east AS est_north", "ord * 2e0 AS t_s", "est_east AS cov_ee")
    innovations = sorted(map(tuple, ordered.innovations(fixes).collect()), key=repr)
    monkeypatch.setattr(ordered, "LARGE", 1)
    assert ordered.in_blocks(track, 1).filter("__own").groupBy("run_id").agg(F.countDistinct("__block").alias("n")).agg(F.max("n")).first()[0] > 20
    assert sorted(map(tuple, outages.growing_covariance(track).collect()), key=repr) == whole
    assert sorted(map(tuple, ordered.innovations(fixes).collect()), key=repr) == innovations


def test_quantiles_spread_a_group_over_tasks(spark):
    df = spark.range(5000).selectExpr("id % 2 AS k", "CAST(id * 7919 % 5000 AS DOUBLE) AS v")
    made = exact_quantiles(df, ["k"], {"m": (F.col("v"), 0.5)})
    assert "__salt" in plan(made)
    got = {r["k"]: r["m"] for r in made.collect()}
    assert got == {r["k"]: r["m"] for r in df.groupBy("k").agg(F.median("v").alias("m")).collect()}


def test_knots_without_rows_are_no_unknowns(spark, monkeypatch):
    rng = np.random.default_rng(2)
    t = np.array([0.0, 1.0, 2.5, 800.0, 801.0, 1600.5])
    a = rng.uniform(-20, 20, (6, 2))
    b = a + rng.uniform(-1, 1, (6, 2)) + t[:, None] / 400
    solved, solve = [], align.solve_tridiagonal
    monkeypatch.setattr(align, "solve_tridiagonal", lambda d, *rest: solved.append(len(d)) or solve(d, *rest))
    p = align.fit_knots(t, a, b, 2.0, 0.5, 2.0, 5)
    assert len(p) == 802 and max(solved) <= 8
    rows = [(run, float(x), *map(float, (*a[i], *b[i]))) for run in ("r", None, "s") for i, x in enumerate(t)] + [("u", 1.0, 1.0, 1.0, 1.0, 1.0)]
    pairs = spark.createDataFrame(rows, "run_id string, t_s double, ax double, ay double, bx double, by double")
    monkeypatch.undo()
    got = align.knots(pairs, 2.0, rounds=5).collect()
    assert sorted((x["run_id"] or "", x["knot"]) for x in got) == [(run, k) for run in ("", "r", "s") for k in range(802)]
    assert all([x["heading"], x["dx"], x["dy"]] == pytest.approx(p[x["knot"]], abs=1e-9) for x in got)


def test_map_windows_shuffle_centres_and_not_their_squares(spark):
    cells = spark.range(-40, 1200).selectExpr("id div 40 - 3 AS r", "id % 40 - 5 AS c", "CAST(id AS DOUBLE) AS v").filter("v % 7 <> 3")
    held = {(x["r"], x["c"]): x["v"] for x in cells.collect()}
    at = [(1, -0.5, -1.5), (2, 31.9999, 0.99999999999999989), (3, 4.2, 28.5), (4, 90.0, 90.0), (5, None, 1.0), (5, 0.0, 0.0)]
    centres = spark.createDataFrame(at, "id int, x double, y double")
    for toward_zero, cell in ((False, math.floor), (True, int)):
        made = maps.extract_window(centres, cells, 2, toward_zero)
        nodes = re.findall(r"Exchange|Join|Generate", plan(made))
        assert nodes[:2] == ["Generate"] * 2 and "Join" in nodes  # squares come last
        want = sorted((i, dr, dc, held.get((cell(y + dr), cell(x + dc)), 0.0) if x is not None else 0.0) for i, x, y in at for dr in range(-2, 3) for dc in range(-2, 3))
        assert sorted((x["id"], x["dr"], x["dc"], x["v"]) for x in made.collect()) == want


def test_shifts_of_an_image_are_compared_where_its_pixels_are(spark):
    rng = np.random.default_rng(4)
    rows = [(i, r, c, float(rng.normal()) + 9 * (i == 3)) for i in (1, 2, 3) for r in range(-2, 35) for c in range(30, 38 + i) if (r + c) % 5]
    a = spark.createDataFrame([*rows, (4, 0, 0, 1.0), (4, 0, 1, 1.0), (5, 0, 0, None)], "image int, r long, c long, v double")
    b = a.withColumns({"r": F.col("r") + 1, "c": F.col("c") - 2, "v": F.col("v") * 2 + 1})
    made = grids.best_shift(a, b, 2)
    assert plan(made).count("Exchange hashpartitioning") == 1
    got = {x["image"]: (x["dr"], x["dc"], x["score"]) for x in made.collect()}
    assert {k: v[:2] for k, v in got.items()} == {1: (-1, 2), 2: (-1, 2), 3: (-1, 2), 4: (-1, 1), 5: (-1, 2)}
    assert all(got[k][2] == pytest.approx(1.0) for k in (1, 2, 3)) and got[4][2] is None and got[5][2] is None


def test_images_come_whole_from_batches_of_cells():
    import pyarrow as pa

    rows = [(k, i) for k, n in ((3, 5), (None, 4), (1, 1), (7, 9)) for i in range(n)]
    schema = pa.schema([("image", pa.int64()), ("v", pa.int64())])
    batches = [pa.RecordBatch.from_pylist([{"image": k, "v": i} for k, i in rows[at : at + 2]], schema) for at in range(0, len(rows), 2)]
    parts = list(kernels.whole_groups(iter(batches), ["image"]))
    assert [(x["image"], x["v"]) for t, _ in parts for x in t.to_pylist()] == rows
    groups = [t["image"][int(s)].as_py() for t, starts in parts for s in starts]
    assert groups == [3, None, 1, 7] and max(len(t) for t, _ in parts) <= 9


def test_images_are_refined_from_cells_and_not_from_arrays_of_rows(spark):
    pixels = spark.range(640).selectExpr("id div 64 AS image", "id % 64 div 8 AS r", "id % 8 AS c", "CAST(id * id % 17 AS DOUBLE) AS v")
    pairs = kernels.image_pairs(pixels, pixels)
    assert pairs.columns == ["image", "r", "c", "a", "b"] and plan(pairs).count("Exchange hashpartitioning") == 1
    got = sorted(tuple(x)[:4] for x in kernels.refine_shift(pairs, 5).collect())
    assert got == [(i, pytest.approx(0.0), pytest.approx(0.0), pytest.approx(0.0)) for i in range(10)]


def test_rays_in_parts_of_the_plane_are_those_by_joins(spark, monkeypatch):
    side = spark.range(-30, 30)
    terrain = side.select(F.col("id").alias("r")).crossJoin(side.select(F.col("id").alias("c"))).selectExpr("r", "c", "CAST(pmod(r * r + 3 * c, 11) AS DOUBLE) AS z", "CAST(pmod(c, 2) AS DOUBLE) AS lidar").filter("pmod(r * c, 13) <> 1")
    pixels = spark.range(64).selectExpr("0L AS image", "id div 8 AS r", "id % 8 AS c", "CAST(id AS DOUBLE) AS v")
    tilted = [1.0, 0.0, 0.0, 0.0, -0.8, 0.6, 0.0, -0.6, -0.8]
    rows = [(0, 0.3, -1.2, 33.0, tilted), (1, -29.0, 28.0, 36.0, tilted), (2, 500.0, 0.0, 31.0, tilted), (3, 1.0, 1.0, 900.0, tilted), (4, None, 1.0, 31.0, tilted)]
    frames = spark.createDataFrame(rows, "image long, cx double, cy double, cz double, rot array<double>")
    camera = warp.Camera(8.0, 8.0, 4.0, 4.0, 8, 8)
    laid = lambda f: warp.warp(f, pixels, terrain, 1.0, camera, 3, 2.7, rounds=2)
    assert plan(laid(frames.filter("image < 3"))).count("Exchange") <= 10
    parts = {(x["image"], x["r"], x["c"]): tuple(x)[3:] for x in laid(frames).collect()}
    monkeypatch.setattr(warp, "REACH", 1)
    joins = {(x["image"], x["r"], x["c"]): tuple(x)[3:] for x in laid(frames).collect()}
    assert len(parts) == len(joins) == 45
    assert all(parts[k] == tuple(pytest.approx(v, abs=1e-9) if isinstance(v, float) else v for v in joins[k]) for k in joins)
