"""Operators on small cases with known results."""

from __future__ import annotations

import json
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import grids, kernels, metrics, ordered
from plumbline.plans import catalog
from plumbline.sources import records
from plumbline.streaming import stateful

FIX = "ord long, accepted boolean, est_east double, est_north double, gt_east double, gt_north double, est_yaw double, gt_yaw double, latency_ms double, terrain string"


def fixes(spark, errors, accepted=True, terrain="urban"):
    return spark.createDataFrame([(i, accepted, float(e), 0.0, 0.0, 0.0, 0.0, 0.0, 100.0, terrain) for i, e in enumerate(errors)], FIX)


def test_accuracy_is_over_accepted_rows(spark):
    r = metrics.fix_level(fixes(spark, range(1, 101))).first()
    assert (r["a_at_5"], r["a_at_20"], r["a_at_50"], r["ifr"]) == (0.05, 0.2, 0.5, 0.5)
    mixed = fixes(spark, [80.0] * 10).union(fixes(spark, [1.0] * 90, False))
    r = metrics.fix_level(mixed).first()
    assert (r["a_at_20"], r["ifr"], r["acceptance_rate"]) == (0.0, 1.0, 0.1)
    r = metrics.fix_level(fixes(spark, [1.0] * 20, False)).first()
    assert r["ifr"] is None and r["acceptance_rate"] == 0.0
    assert metrics.fix_level(fixes(spark, [float("nan"), 10.0])).first()["ifr"] == 0.0


def test_terrain_split_drops_unlisted(spark):
    df = fixes(spark, [1.0] * 3).union(fixes(spark, [60.0] * 2, terrain="desert"))
    got = {r["terrain"]: r["n_attempts"] for r in metrics.fix_level_by_terrain(df).collect()}
    assert got == {"all": 5, "urban": 3}


def test_dual_bias(spark):
    got = {r["mode"]: r["a_at_5"] for r in metrics.dual_bias(fixes(spark, [10.0] * 5), (10.0, 0.0)).collect()}
    assert got == {"with": 0.0, "without": 1.0}


@pytest.mark.parametrize(("metric", "gold", "cur", "verdict"), [("a_at_20", 1.0, 0.96, "PASS"), ("a_at_20", 1.0, 0.94, "FAIL"), ("ifr", 0.003, 0.0035, "PASS"), ("ifr", 0.003, 0.0045, "FAIL"), ("re_p95_deg", 1.0, 1.04, "PASS"), ("re_p95_deg", 1.0, None, "NOT_COMPUTED")])
def test_golden(spark, metric, gold, cur, verdict):
    c, g = (spark.createDataFrame([(metric, v)], "metric string, value double") for v in (cur, gold))
    got = metrics.compare_golden(c, g)
    assert got.first()["verdict"] == verdict and metrics.overall_verdict(got).first()[0] == ("FAIL" if verdict == "FAIL" else "PASS")


def test_terrain_rules(spark):
    names = ("building", "road", "farmland", "forest", "water")
    cases = [({"building": 0.2}, "urban"), ({"building": 0.05}, "suburban"), ({"road": 0.1}, "roads"), ({"farmland": 0.7}, "farmland"), ({"forest": 0.7}, "forest"), ({"water": 0.6, "building": 0.3}, "water"), ({}, "background"), ({"building": 0.2, "farmland": 0.7}, "urban")]
    for shares, want in cases:
        row = spark.range(1).select(metrics.terrain_of({n: F.lit(shares.get(n, 0.0)) for n in names}).alias("t")).first()
        assert row["t"] == want


def test_tag_classes(spark):
    cases = [({"natural": "water"}, 3), ({"waterway": "river"}, 3), ({"landuse": "basin"}, 3), ({"building": "yes", "highway": "x"}, 2), ({"building:part": "yes"}, 2), ({"highway": "path"}, 1), ({"landuse": "farmyard"}, 4), ({"natural": "wood"}, 5), ({"landuse": "forest"}, 5), ({"name": "x"}, None), (None, None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, tags map<string,string>")
    assert [r["c"] for r in df.orderBy("i").select(metrics.class_of_tags(F.col("tags")).alias("c")).collect()] == [c for _, c in cases]


def test_interpolation_holds_ends_and_gaps(spark):
    left = spark.createDataFrame([("a", t) for t in (-1.0, 0.0, 0.5, 1.0, 3.0, 9.0)], "run_id string, t_s double")
    right = spark.createDataFrame([("a", 0.0, 0.0), ("a", 1.0, 10.0), ("a", 5.0, 50.0)], "run_id string, t_s double, v double")
    got = {r["t_s"]: r["v"] for r in ordered.interpolate(left, right, ["v"], max_gap=2.0).collect()}
    assert got == {-1.0: 0.0, 0.0: 0.0, 0.5: 5.0, 1.0: 10.0, 3.0: 10.0, 9.0: 50.0}
    assert {r["t_s"]: r["v"] for r in ordered.interpolate(left, right, ["v"]).collect()}[3.0] == 30.0


def test_baseline_ratio(spark):
    rows = [("a", i, i * 0.3, 12.0 * i * 0.3, 0.0, 12.0, 0.0) for i in range(60)]
    df = spark.createDataFrame(rows, "run_id string, ord long, t_s double, east double, north double, v_east double, v_north double")
    r = ordered.baseline_ratio(df).first()
    assert r["ratio"] == pytest.approx(1.0) and r["n"] == 50
    swapped = df.withColumns({"east": F.col("north"), "north": F.col("east") * 1.3})
    assert ordered.baseline_ratio(swapped).first()["ratio"] == pytest.approx(1.3)


def test_max_gap_needs_two(spark):
    df = spark.createDataFrame([("a", 0, 0.0, True), ("a", 1, 5.0, False), ("a", 2, 9.0, True), ("b", 0, 1.0, True)], "run_id string, ord long, path_m double, accepted boolean")
    assert {r["run_id"]: r["max_gap"] for r in ordered.max_gap(df).collect()} == {"a": 9.0, "b": None}


def test_a_path_of_two_kilometres_is_not_below_them(spark, tmp_path):
    steps = (541.41, 580.04, 878.55)
    assert steps[0] + steps[1] + steps[2] < 2000  # as doubles, one by one; their sum is 2,000.00
    runs = [*permutations(steps), (541.41, 580.04, 878.54), (541.41, 580.04, 878.54999), (541.41, float("nan"), 1.0), (None, 2000.0, 1.0)]
    rows = [(3 * u + i, u, "purchase", v) for u, run in enumerate(runs) for i, v in enumerate(run)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["run_id"]: r["n"] for r in catalog.REGISTRY["a09_early_fixes"][0](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate([2] * 6 + [3, 3, 1, 0]))


def test_a_standing_run_at_the_edge_of_a_tile_is_in_the_next(spark, tmp_path):
    rows = [(i, 1, "view", v) for i, v in enumerate((541.41, 580.04, 878.55, 0.0))]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["ord"]: r["tile_e"] for r in catalog.REGISTRY["t03_look_ahead"][0](spark, str(tmp_path)).collect()}
    assert got[3] == 40  # 2,000.00 m in tiles of 50 m


def test_focal_median_replaces_a_spike(spark):
    rows = [(r, c, 10.0) for r in range(6) for c in range(6) for _ in range(4)] + [(3, 3, 60.0)]
    got = {(r["r"], r["c"]): (r["z"], r["confidence"]) for r in grids.focal_median(grids.accumulate(spark.createDataFrame(rows, "r long, c long, z double"))).collect()}
    assert got[(3, 3)] == (10.0, 96) and got[(0, 0)] == (10.0, 255)


def test_polygon_mask_of_a_square(spark):
    ring = [(2.0, 2.0), (6.0, 2.0), (6.0, 5.0), (2.0, 5.0)]
    edges = [(1, *a, *b) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
    cells = spark.range(10).select(F.col("id").alias("r")).withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))))
    got = grids.polygon_mask(spark.createDataFrame(edges, "ring int, x1 double, y1 double, x2 double, y2 double"), cells)
    assert {(r["r"], r["c"]) for r in got.collect()} == {(r, c) for r in range(2, 5) for c in range(2, 6)}


def test_paint_order(spark):
    df = spark.createDataFrame([(0, 0, 4), (0, 0, 2), (0, 0, 3), (0, 1, 5), (0, 1, 1)], "r int, c int, class int")
    assert {(r["r"], r["c"]): r["class"] for r in grids.paint(df).collect()} == {(0, 0): 3, (0, 1): 1}


def test_rigid_fit(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(50, 2)) * 10
    th, k = 0.7, 1.5
    b = k * a @ np.array([[np.cos(th), -np.sin(th)], [np.sin(th), np.cos(th)]]).T + [3, -4]
    df = spark.createDataFrame([("x", *map(float, (*p, *q))) for p, q in zip(a, b, strict=True)], "g string, ax double, ay double, bx double, by_ double")
    r = grids.rigid2d(df, ["g"], True).first()
    assert (r["theta"], r["scale"], r["tx"], r["ty"]) == pytest.approx((th, k, 3, -4))


def turned(spark, folder, flag, scale):
    """Fixes of a square turned by a quarter and scaled: est is scale * (-north, east); partkeys and quantities that give it."""
    square = [(16, 10), (20, 10), (16, 14), (20, 14)]
    part = lambda x, y: next(p for p in range(x, 997 * 61, 997) if p % 61 == 30 + scale * x - y)
    rows = [(flag, i, 1, part(x, y), y, 25.0 - (scale * y + x) / 2, 0.0, 0.0, 0.0) for i, (x, y) in enumerate(square)]
    schema = "l_returnflag string, l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double"
    spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{folder}/lineitem.parquet")


def test_rigid_fit_of_turned_fixes(spark, tmp_path):
    turned(spark, tmp_path, "A", 1)
    turned(spark, tmp_path, "B", 2)  # held at scale 1
    got = {r["run_id"]: r.asDict() for r in catalog.REGISTRY["n02_rigid_fit"][0](spark, str(tmp_path)).collect()}
    want = {"n": 4, "theta": pytest.approx(np.pi / 2, abs=1e-5), "scale": 1.0}
    assert got == {"run_A": {"run_id": "run_A", **want, "tx": 0.0, "ty": 0.0}, "run_B": {"run_id": "run_B", **want, "tx": -12.0, "ty": 18.0}}


def test_similarity_fit_of_turned_fixes(spark, tmp_path):
    turned(spark, tmp_path, "A", 1)
    turned(spark, tmp_path, "B", 2)
    got = {r["run_id"]: (r["theta"], r["scale"]) for r in catalog.REGISTRY["n03_similarity_fit"][0](spark, str(tmp_path)).collect()}
    assert got == {"run_A": (pytest.approx(np.pi / 2, abs=1e-5), 1.0), "run_B": (pytest.approx(np.pi / 2, abs=1e-5), 2.0)}


def texture(n=64, shift=(0, 0), seed=3):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:n, 0:n]
    img = np.zeros((n, n))
    for cy, cx, s in zip(rng.uniform(0, n, 60), rng.uniform(0, n, 60), rng.uniform(1, 3, 60), strict=True):
        img += np.exp(-(((y - cy - shift[1]) ** 2 + (x - cx - shift[0]) ** 2) / (2 * s * s)))
    return img


def test_phase_correlation_finds_a_shift():
    dx, dy, peak, ratio = kernels.phase_correlation(texture() * kernels.hann2(64, 64), texture(shift=(5, -3)) * kernels.hann2(64, 64))
    assert (dx, dy) == pytest.approx((5, -3), abs=0.5) and ratio > 1.2


def test_refine_finds_a_part_of_a_pixel():
    dx, dy, yaw, _, share = kernels.refine(texture(), texture(shift=(0.6, -0.4)), 25, 4.685)
    assert (dx, dy, yaw) == pytest.approx((0.6, -0.4, 0), abs=0.05) and share > 0.5


def test_rigid3_is_a_rotation():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(20, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q = q * np.sign(np.linalg.det(q))
    r, t = kernels.rigid3(a, a @ q.T + [1, 2, 3])
    assert np.allclose(r, q) and np.allclose(t, [1, 2, 3])


def test_csv_booleans_survive(spark, tmp_path):
    row = ["run", "B", "x86", 1.5, 0, 1, True, *[0.0] * 3, *[1.0] * 3, *[1.0] * 6, 0.0, 0.0, "urban", 1, 1, *[0.5] * 7, 12.25]
    df = spark.createDataFrame([tuple(row), (*row[:6], False, *row[7:])], records.FIXES)
    records.write_records(df, f"{tmp_path}/t.csv")
    back = records.read_records(spark, f"{tmp_path}/t.csv")
    assert sorted(r["accepted"] for r in back.collect()) == [False, True] and back.schema == df.schema
    records.check_contract(back, records.FIXES, ("gt_east",))
    with pytest.raises(ValueError, match="not finite"):
        records.check_contract(back.withColumn("gt_east", F.lit(float("nan"))), records.FIXES, ("gt_east",))
    assert records.empty(spark, records.TRACK).count() == 0


def test_json_features_and_rings(spark):
    osm = {"elements": [{"type": "node", "id": 1, "lat": 1.0, "lon": 2.0}, {"type": "way", "id": 9, "nodes": [1, 2], "tags": {"building": "yes"}}, {"type": "way", "id": 8, "nodes": [1], "tags": {"name": "x"}}]}
    nodes, ways = records.map_features(spark.createDataFrame([(json.dumps(osm),)], "value string"))
    assert nodes.count() == 1 and [(r["id"], r["class"]) for r in ways.collect()] == [(9, 2)]
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    texts = [{"type": "Polygon", "coordinates": [ring, ring]}, {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}, {"type": "FeatureCollection", "features": [{"geometry": {"type": "Polygon", "coordinates": [ring]}}]}, {"type": "GeometryCollection", "geometries": [{"type": "Polygon", "coordinates": [ring]}]}]
    assert records.rings(spark.createDataFrame([(json.dumps(t),) for t in texts], "value string")).count() == 5
    bad = spark.createDataFrame([(float("nan"), float("inf"), 1.0)], "a double, b double, c double")
    assert json.loads(records.to_json_rows(bad).first()["value"]) == {"a": None, "b": None, "c": 1.0}


def test_tiles_on_disk(spark, tmp_path):
    df = spark.range(40 * 40).select(F.lit("z").alias("layer"), F.lit(0).alias("level"), F.floor(F.col("id") / 40).alias("r"), (F.col("id") % 40).alias("c"), F.col("id").cast("double").alias("v"))
    records.write_tiles(df, f"{tmp_path}/t", 16)
    got = records.read_window(spark, f"{tmp_path}/t", "z", 0, 10, 12, 8, 9, 16)
    assert got.count() == 72 and got.agg(F.min("v")).first()[0] == 412.0
    best = records.by_priority(spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 5, "c")], "tile int, p int, src string"), ["tile"], "p")
    assert {r["tile"]: r["src"] for r in best.collect()} == {1: "a", 2: "c"}


def test_stream_equals_its_batch_twin(spark, tmp_path):
    rows = [(r, i, float(i), float(v)) for r in (1, 2) for i, v in enumerate([1, 2, 90, 91, 92, 93, 94, 3, 4])]
    df = spark.createDataFrame(rows, "run_id long, ord long, t double, value double")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    made, output = stateful.consistency_step(3, 10.0), "accepted boolean, run int"
    twin = sorted(map(tuple, stateful.batch_twin(df, made, output).collect()))
    assert [a for _, _, a, _ in twin[:9]] == [True, True, False, False, True, True, True, False, False]
    source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = stateful.stream(source, made, "last double, run int, lo double, hi double", output).writeStream.format("memory").queryName("gate").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("gate").collect())) == twin


def test_modes():
    step, state = stateful.mode_step()
    seen = []
    for t, v in [(0, 5), (1, 22), (2, 30), (30, 40), (300, 40), (301, 5), (302, 5)]:
        state, (mode, _) = step(state, type("R", (), {"t": t, "value": v}))
        seen.append(mode)
    assert seen == ["nominal", "nominal", "degraded", "coasting", "lost", "recovery", "nominal"]


def test_knots_find_a_slow_turn():
    from plumbline.operators import align

    t = np.arange(0, 40, 0.5)
    a = np.stack([5 * t, 20 * np.sin(t / 4)], axis=1)
    th = 0.3 + 0.002 * t
    b = np.stack([np.cos(th) * a[:, 0] - np.sin(th) * a[:, 1] + 3, np.sin(th) * a[:, 0] + np.cos(th) * a[:, 1] - 2], axis=1)
    b[10] += 50  # an outlier
    p = align.fit_knots(t, a, b, 2.0, 0.05, 2.0, 50)
    far = np.linalg.norm(align.corrected(t, a, p, 0.0, 2.0) - b, axis=1)
    assert np.median(far) < 0.3 and far[10] > 40
    turn = align.shortest_turn(np.array([1.0, 0, 0]), np.array([-1.0, 0, 0]))
    assert np.allclose(turn @ [1, 0, 0], [-1, 0, 0]) and np.isclose(np.linalg.det(turn), 1)


def test_upper_median_counts_first(spark):
    groups = {"odd": [5, 1, 9], "even": [4, 1, 3, 2], "ties": [7, 7, 1, 7, 2, 2], "one": [3], "nulls": [None, 8, 6, None, 9], "void": [None, None, 1]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "g string, v long")
    want = {k: sorted(vs, key=lambda v: (v is not None, v))[len(vs) // 2] for k, vs in groups.items()}
    assert {r["g"]: r["median"] for r in metrics.upper_median(df, ["g"], "v").collect()} == want
    query, _ = catalog.REGISTRY["a42_upper_median"]
    assert "collect_list" not in query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_groups_do_not_pass_whole(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g, n in (("x", 400), ("y", 7), ("z", 2)):
        a = rng.normal(size=(n, 3)) * 50
        turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
        b = a @ (turn * np.sign(np.linalg.det(turn))).T + rng.normal(size=(n, 3)) + 9
        rows += [(g, *map(float, p), *map(float, q)) for p, q in zip(a, b, strict=True)]
    df = spark.createDataFrame(rows, "g string, ax double, ay double, az double, bx double, by double, bz double")
    fits = kernels.fit_rigid3(df, ["g"])
    got = {r["g"]: r for r in fits.collect()}
    assert set(got) == {"x", "y"} and got["x"]["n"] == 400
    for g, r in got.items():
        a, b = (np.array([row[i : i + 3] for row in rows if row[0] == g]) for i in (1, 4))
        turn, move = kernels.rigid3(a, b)
        assert np.allclose(r["rotation"], turn.ravel()) and np.allclose(r["translation"], move)
        assert r["rms"] == pytest.approx(np.sqrt(np.mean(np.sum((a @ turn.T + move - b) ** 2, axis=1))))
    events = spark.createDataFrame([(k, i, float(i), float((i * 37 + (k or 0)) % 90)) for k in (1, 2, None) for i in range(60)], "run_id long, ord long, t double, value double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for made, output in ((stateful.consistency_step(), "accepted boolean, run int"), (stateful.mode_step(), "mode string, quiet_s double"), (stateful.cache_step(20.0), "hit boolean, misses int")):
            folded, want = stateful.batch_twin(events, made, output), set()
            for k in (1, 2, None):
                state = made[1]
                for row in sorted((r for r in events.collect() if r["run_id"] == k), key=lambda r: r["ord"]):
                    state, out = made[0](state, row)
                    want.add((k, row["ord"], *out))
            assert {tuple(r) for r in folded.collect()} == want
            assert "FlatMapGroups" not in folded._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroups" not in fits._jdf.queryExecution().optimizedPlan().toString()


def test_exact_quantiles_of_large_groups(spark):
    """Beyond the size at which the sketch bounds them: ties, negatives, nulls and NaN."""
    from plumbline.operators.quantiles import exact_quantiles

    rng = np.random.default_rng(3)
    v = np.round(rng.normal(0, 50, 60_000), 1)
    rows = spark.createDataFrame([(int(i % 3 == 0), float(x)) for i, x in enumerate(v)], "g int, v double").union(spark.createDataFrame([(None, 5.0), (None, None), (7, None), (8, float("nan"))], "g int, v double"))
    got = {r["g"]: r for r in exact_quantiles(rows, ["g"], {"p5": (F.col("v"), 0.05), "p50": (F.col("v"), 0.5), "p99": (F.col("v"), 0.999)}).collect()}
    for g, part in ((1, v[::3]), (0, np.delete(v, np.arange(0, len(v), 3)))):
        assert [got[g][c] for c in ("p5", "p50", "p99")] == pytest.approx(np.quantile(part, [0.05, 0.5, 0.999]).tolist())
    assert got[None]["p50"] == 5.0 and got[7]["p50"] is None and np.isnan(got[8]["p5"])
    whole = exact_quantiles(rows.filter("g < 2"), [], {"m": (F.col("v"), 0.5), "top": (F.col("v"), 1.0)}).first()
    assert (whole["m"], whole["top"]) == pytest.approx((np.median(v), v.max()))


def test_pairs_of_one_provider_are_an_error(spark):
    from plumbline.operators import generate

    ids = spark.range(5)
    for names in (("a", "a"), ("a",), ("a", "b", "a")):
        with pytest.raises(ValueError, match="different"):
            generate.pair_specs(ids, providers=names)
    specs = generate.pair_specs(ids, providers=("a", "b", "c")).collect()
    assert all(r["query_provider"] != r["map_provider"] and r["delta_east"] == pytest.approx(-r["off_east"]) for r in specs)
    same = spark.createDataFrame([("a", "a")], "q string, m string")
    with pytest.raises(Exception, match="of one provider"):
        same.select(generate.cross_provider(F.col("q"), F.col("m"))).collect()


def test_placeholders_need_repeats_and_no_texture(spark):
    rows = [(i, "card", 2.0) for i in range(4)] + [(10 + i, "water", 2.0) for i in range(3)] + [(20 + i, "field", 40.0) for i in range(6)] + [(30, None, 1.0)]
    got = grids.placeholder_tiles(spark.createDataFrame(rows, "tile long, digest string, spread double"))
    assert {r["tile"] for r in got.collect()} == {0, 1, 2, 3}


def test_rings_clear_cells_once(spark):
    square = lambda k, x, y, n: [(k, float(a), float(b), float(c), float(d)) for (a, b), (c, d) in zip(((x, y), (x + n, y), (x + n, y + n), (x, y + n)), ((x + n, y), (x + n, y + n), (x, y + n), (x, y)), strict=True)]
    edges = spark.createDataFrame(square(1, 0, 0, 4) + square(2, 2, 2, 4) + square(3, 50, 50, 2), "ring long, x1 double, y1 double, x2 double, y2 double")
    mask = spark.createDataFrame([(r, c, 255) for r in range(8) for c in range(8)], "r long, c long, v int")
    left, cleared = grids.clear_polygons(mask, edges)
    assert {r["ring"]: r["cleared"] for r in cleared.collect()} == {1: 16, 2: 12}
    assert left.filter("v = 0").count() == 28 and left.count() == 64


def test_kernels_sample_and_turn():
    img = np.arange(25.0).reshape(5, 5)
    assert kernels.bilinear_at(img, np.array([1.5, 0.0, 4.0, 4.1]), np.array([2.25, 0.0, 4.0, 1.0])).tolist() == [9.75, 0.0, 24.0, 0.0]
    turned = kernels.rotate_image(img, np.pi / 2)
    assert np.allclose(turned, np.rot90(img, 1)) or np.allclose(turned, np.rot90(img, -1))
    assert np.allclose(kernels.log_polar(np.ones((32, 32)), 8, 6), 1.0)


def test_turned_images_match(spark):
    """A turn that the sweep has not, found from the spectra."""
    rng = np.random.default_rng(3)
    f = np.hypot(*np.meshgrid(np.fft.fftfreq(64), np.fft.fftfreq(64)))
    img = np.real(np.fft.ifft2(np.fft.fft2(rng.normal(size=(64, 64))) * np.exp(-((f / 0.12) ** 2))))
    img = (img - img.min()) / (img.max() - img.min()) * 255
    for turn in (-12.0, 7.0):
        angle, scale = kernels.rotation_and_scale(img, kernels.rotate_image(img, np.radians(turn)))
        assert np.degrees(angle) == pytest.approx(-turn, abs=1.0) and scale == pytest.approx(1, abs=0.02)
    table = lambda x: spark.createDataFrame([(0, r, c, float(x[r, c])) for r in range(64) for c in range(64)], "image long, r long, c long, v double")
    got = kernels.match_images(kernels.image_pairs(table(img), table(kernels.rotate_image(img, np.radians(7.0)))), spectral=True).first()
    assert got["rotation_deg"] == pytest.approx(7.0, abs=1.0) and abs(got["dx"]) < 1 and abs(got["dy"]) < 1


def test_equal_points_are_sampled_each(spark):
    pixels = spark.createDataFrame([(1, r, c, 10.0 + c) for r in range(40) for c in range(40) if (r, c) != (33, 33)], "image long, r long, c long, v double")
    points = spark.createDataFrame([(1, 0.0, 1.0), (1, 0.0, 1.0), (1, 31.5, 31.25), (1, 32.5, 33.0), (1, 39.0, 39.0), (1, 39.5, 1.0), (2, 1.0, 1.0), (None, 1.0, 1.0), (1, None, 1.0)], "image long, x double, y double")
    got = sorted(map(str, (tuple(r) for r in grids.bilinear(points, pixels, half_pixel=False).collect())))
    want = [(1, 0.0, 1.0, 10.0), (1, 0.0, 1.0, 10.0), (1, 31.5, 31.25, 41.5), (1, 32.5, 33.0, None), (1, 39.0, 39.0, 49.0), (1, 39.5, 1.0, None), (2, 1.0, 1.0, None), (None, 1.0, 1.0, None), (1, None, 1.0, None)]
    assert got == sorted(map(str, want))


def test_tiles_hold_every_cell_once(spark):
    cells = spark.createDataFrame([(0, -1, -1, 1.0), (0, 0, 0, 2.0), (0, 31, 5, None), (0, 32, 5, 4.0), (7, 3, 3, 5.0)], "image long, r long, c long, v double")
    got = {(r["image"], r["tr"], r["tc"]): r for r in grids.tiled(cells, ["image"], ["v"]).collect()}
    assert set(got) == {(0, -1, -1), (0, 0, 0), (0, 1, 0), (7, 0, 0)}
    one = got[0, 0, 0]
    assert (one["r0"], one["c0"], one["w"], one["h"]) == (0, 0, 6, 32) and one["v"][0] == 2.0 and len(one["v"]) == 192 and one["v"].count(None) == 191
    halo = {(r["tr"], r["tc"]): r for r in grids.tiled(cells, ["image"], ["v"], halo=1).filter("image = 0").collect()}
    assert halo[0, 0]["h"] == 33 and halo[0, 0]["v"][32 * 6 + 5] == 4.0 and halo[-1, -1]["v"] == [1.0, None, None, 2.0]


def test_windows_over_gaps_and_edges(spark):
    rng = np.random.default_rng(3)
    have = {(int(r), int(c)): int(k) for r, c, k in zip(rng.integers(-20, 20, 500), rng.integers(5, 45, 500), rng.integers(0, 3, 500), strict=True)}
    cells = spark.createDataFrame([(r, c, k) for (r, c), k in have.items()], "r long, c long, class int")
    places = [(i, int(r), int(c)) for i, (r, c) in enumerate(zip(rng.integers(-30, 30, 200), rng.integers(-5, 60, 200), strict=True))]
    got = {r["id"]: r for r in grids.window_fractions(spark.createDataFrame(places, "id long, r long, c long"), cells, 4, 3).collect()}
    for i, r, c in places:
        near = [k for (y, x), k in have.items() if abs(y - r) <= 4 and abs(x - c) <= 4]
        assert (i in got) == bool(near)
        if near:
            assert got[i]["n"] == len(near) and all(got[i][f"f{k}"] == pytest.approx(near.count(k) / len(near)) for k in range(3))


def test_windowed_offset_finds_the_shift(spark):
    rng = np.random.default_rng(4)
    v = rng.integers(0, 200, (60, 60))
    a = spark.createDataFrame([(r, c, int(v[r, c])) for r in range(60) for c in range(60)], "r long, c long, v long")
    b = a.select((F.col("r") + 1).alias("r"), (F.col("c") - 1).alias("c"), "v")
    got = grids.windowed_offset(a, b, 8, 16, 1).collect()
    assert len(got) >= 9 and {(r["dr"], r["dc"]) for r in got} == {(-1, 1)} and all(r["ncc"] == pytest.approx(1.0) for r in got)
    flat = grids.windowed_correlation(a.withColumn("v", F.lit(3)), a, 8, 16).collect()
    assert flat and all(r["ncc"] is None for r in flat)


def test_inner_rings_are_holes(spark):
    def ring(n, a, b):
        p = [(a, a), (b, a), (b, b), (a, b)]
        return [(1, n, *map(float, (*p[i], *p[(i + 1) % 4]))) for i in range(4)]

    edges = spark.createDataFrame(ring(1, 0, 10) + ring(2, 3, 7) + ring(3, 4, 6), "area long, ring long, x1 double, y1 double, x2 double, y2 double")
    cells = {(r["r"], r["c"]) for r in grids.area_cells(edges).collect()}
    inside = lambda v, a, b: a <= v < b
    assert cells == {(r, c) for r in range(10) for c in range(10) if sum(inside(r, a, b) and inside(c, a, b) for a, b in ((0, 10), (3, 7), (4, 6))) % 2}
