"""Packages, layers and results: what is written comes back, what is not valid is refused."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from plumbline.operators import windows
from plumbline.sources import packages as p

PROVIDER = {"id": "sat", "license": "free", "attribution": "by all"}
BUILT = {"file": "o.tif", "validity_file": "o_ok.tif", "gsd": 0.5, "native_gsd": 0.4, "zoom": 18, "expected": 100, "missing": 7}


def manifest():
    m = {"crs": "EPSG:32637", "origin": [45.0, 39.0, 120.0], "layers": {}}
    m = p.with_ortho(m, "ortho_sat", BUILT, PROVIDER)
    m = p.with_dem(m, {"file": "d.tif", "gsd": 10.0, "native_gsd": 30.0, "source_datum": "a", "vertical_datum": "b", "geoid_model": "c", "datasets": ["one", "two"]})
    return p.with_semantic(m, {"file": "s.tif", "gsd": 1.0}, "2026-01-01")


def test_manifest_round_trip_and_refusals(spark, tmp_path):
    m = manifest()
    assert m["layers"]["ortho_sat"]["tiles"] == {"expected": 100, "fetched": 93, "missing": 7} and m["layers"]["dem"]["source"] == "one+two"
    p.save_manifest(spark, m, f"{tmp_path}/m")
    assert p.load_manifest(spark, f"{tmp_path}/m") == json.loads(json.dumps(m))
    assert {(r["layer"], r["gsd"]) for r in p.layers(spark, m).collect()} == {("ortho_sat", 0.5), ("dem", 10.0), ("semantic", 1.0)}
    for change, text in (({"crs": None}, "crs"), ({"layers": {"radar": {}}}, "unknown"), ({"layers": {"dem": {"source": "x"}}}, "dem geoid_model missing"), ({"layers": {"semantic": {"source": "x", "extract_date": None, "classes": ["road"]}}}, "classes")):
        bad = {k: v for k, v in (m | change).items() if v is not None}
        with pytest.raises(ValueError, match=text):
            p.save_manifest(spark, bad, f"{tmp_path}/bad")
    docs = [("a", m), ("b", {"layers": {"radar": {}, "ortho_x": {"provider": None}, "semantic": {"source": 1, "extract_date": None, "classes": ["road"]}}}), ("c", "no JSON"), ("d", {"crs": 1, "origin": 2, "layers": {}})]
    rows = spark.createDataFrame([(k, v if isinstance(v, str) else json.dumps(v)) for k, v in docs], "package string, value string")
    assert {tuple(r) for r in p.manifest_problems(rows).collect()} == {("b", None, "crs", "missing"), ("b", None, "origin", "missing"), ("b", "radar", None, "unknown layer"), ("b", "semantic", "classes", "other value"), *(("c", None, f, "missing") for f in ("crs", "origin", "layers"))}
    got = spark.createDataFrame([(json.dumps({"a": {"b@20": 0.5}}),)], "v string").select(p.nested("v", "a.b@20"), p.nested("v", "a.c")).first()
    assert tuple(got) == ("0.5", None)
    assert p.finite({"a": [float("nan"), 1.0, {"b": math.inf}]}) == {"a": [None, 1.0, {"b": None}]}


def test_layers_open_in_modes(spark, tmp_path):
    from plumbline.sources.records import write_tiles

    m = manifest()
    px = spark.range(40 * 40).select(F.lit("ortho_sat").alias("layer"), F.lit(0).alias("level"), F.floor(F.col("id") / 40).alias("r"), (F.col("id") % 40).alias("c"), (F.col("id") % 40 * 10.0 - 20).alias("v"))
    write_tiles(px, f"{tmp_path}/o.tif", 16)
    from plumbline.sources import packages

    window = {"level": 0, "r0": 3, "c0": 1, "height": 2, "width": 30}
    got = {}
    for mode in ("float32", "uint8", "gray"):
        rows = packages.read_window(spark, f"{tmp_path}/o.tif", "ortho_sat", 0, 3, 1, 2, 30, 16).withColumn("v", p.pixel_mode(F.col("v"), mode)).collect()
        got[mode] = {(r["r"], r["c"]): r["v"] for r in rows}
    assert len(got["gray"]) == 60 and got["float32"][3, 1] == -10 and got["uint8"][3, 1] == 0 and got["uint8"][4, 30] == 255 and got["gray"][4, 30] == 1
    assert p.open_optional(spark, str(tmp_path), {"layers": {}}, **window) is None
    with pytest.raises(KeyError, match="no layer"):
        p.open_layer(spark, str(tmp_path), m, "radar", **window)


def test_layer_problems(spark):
    schema = "layer string, origin_east double, origin_north double, gsd double"
    named = spark.createDataFrame([("a", 100.0, 200.0, 0.5), ("b", 100.0, 200.0, 0.5), ("c", 1.0, 1.0, 1.0)], schema)
    files = spark.createDataFrame([("a", 100.0, 200.0, 0.5, 0.5), ("b", 100.0, 200.5, 0.5, 0.6)], schema + ", gsd_row double")
    got = {(r["layer"], r["field"]) for r in p.geotransform_problems(named, files).collect()}
    assert got == {("b", "origin_north"), ("b", "gsd_row"), *(("c", f) for f in ("origin_east", "origin_north", "gsd", "gsd_row"))}
    boxes = spark.createDataFrame([("a", 0.5, -1.0, 101.0, 0.0, 50.0), ("b", 0.5, 5.0, 101.0, 0.0, 50.0)], "layer string, gsd double, west double, east double, south double, north double")
    assert [r["layer"] for r in p.coverage_problems(boxes, {"east_min": 0.0, "east_max": 100.0, "north_min": 1.0, "north_max": 50.0}).collect()] == ["b"]


def test_layers_are_refused_with_too_many_placeholders(spark):
    expected = spark.createDataFrame([(x, 0) for x in range(30)], "x long, y long")
    tile = lambda x, blank: (x, 0, "card" if blank else f"t{x}", 2.0 if blank else 50.0)
    few = spark.createDataFrame([tile(x, x < 5) for x in range(28)], "x long, y long, digest string, spread double")
    got = [(r["x"], r["state"]) for r in p.layer_tiles(expected, few).collect()]
    assert got == [(x, "placeholder" if x < 5 else "ok" if x < 28 else "missing") for x in range(30)]
    many = spark.createDataFrame([tile(x, x < 12) for x in range(30)], "x long, y long, digest string, spread double")
    with pytest.raises(Exception, match="too many placeholder"):
        p.layer_tiles(expected, many).collect()


def test_foreign_caches(spark):
    files = spark.createDataFrame([(f"/c/{q}",) for q in ("z12/7/9.png", "z12/7/9.jpg", "z30/1/1.jpg", "z5/3/4.txt", "notes.jpg", "a/Z6\\2\\3.JPEG")], "path string")
    got = {(r["z"], r["x"], r["y"]): r["path"] for r in p.foreign_tiles(files, "sasplanet").collect()}
    assert got == {(11, 7, 9): "/c/z12/7/9.jpg", (5, 2, 3): "/c/a/Z6\\2\\3.JPEG"}
    assert set(p.foreign_tiles(files, "qgis_xyz", cached=spark.createDataFrame([(12, 7, 9)], "z int, x long, y long")).select("z").toPandas()["z"]) == {6}
    with pytest.raises(ValueError, match="layout"):
        p.foreign_tiles(files, "other")
    store = spark.createDataFrame([(1, True), (2, None), (3, False)], "k int, missing boolean")
    left, n = p.without_tombstones(store)
    assert {r["k"] for r in left.collect()} == {2, 3} and n.first()["cleared"] == 1


def test_names_and_figures(spark):
    df = spark.createDataFrame([(44.0, 45.0, 39.0, 40.0, 5, 7)], "s double, n double, w double, e double, x int, y int")
    got = df.select(
        p.box_name("OT", "GLO", F.col("s"), F.col("n"), F.col("w"), F.col("e")), p.tile_url("https://{s}.h/{z}/{x}/{y}", F.col("x"), F.col("y"), F.lit(9), ("a", "b"), F.col("x")),
        p.source_of_tile(F.lit("Cop_10_N44"), {"Cop_10_": "glo30", "Cop_30_": "glo90"}), p.source_of_tile(F.lit("else"), {"Cop_10_": "glo30"}),
        p.shown(F.lit(1234.5678), 2), p.shown(F.lit(float("nan"))), p.cell_error(F.lit(0.0), F.lit(0.0), F.lit(3.0), F.lit(4.0)),
    ).first()
    assert tuple(got) == ("OT_GLO_S43.9900_N45.0100_W38.9900_E40.0100_DEM.tif", "https://b.h/9/5/7", "glo30", "unknown", "1,234.57", "—", 5.0)


def test_surface_in_one_frame(spark, tmp_path):
    cells = spark.createDataFrame([(0, 0, 1.5, 255), (300, 2, 2.5, 128)], "r long, c long, z double, confidence int")
    p.write_surface(cells, f"{tmp_path}/s", "EPSG:32637")
    assert sorted(map(tuple, p.read_surface(spark, f"{tmp_path}/s", "EPSG:32637").collect())) == sorted(map(tuple, cells.collect()))
    with pytest.raises(ValueError, match="different frames"):
        p.read_surface(spark, f"{tmp_path}/s", "EPSG:32638")
    p.write_document(spark, {"format": "surface-1", "crs": "EPSG:32638"}, f"{tmp_path}/s/frame")
    with pytest.raises(ValueError, match="different frames"):
        p.read_surface(spark, f"{tmp_path}/s")


def test_surface_run_meets_the_ground(spark):
    """A plane 5 m too low, far points left out, a tower that isn't ground."""
    pts = spark.range(40 * 40 * 5).select((F.floor(F.col("id") / 5) % 40 + 0.5).alias("east"), (F.floor(F.col("id") / 200) + 0.5).alias("north"), F.lit(10.0).alias("up"), F.lit(50.0).alias("range_m"))
    odd = spark.createDataFrame([(3.5, 3.5, 90.0, 500.0)], "east double, north double, up double, range_m double")
    ground = spark.range(1600).select(F.floor(F.col("id") / 40).alias("r"), (F.col("id") % 40).alias("c"), F.lit(15.0).alias("z"))
    got = p.surface_run(pts.union(odd), ground, 1.0, 100.0).collect()
    assert len(got) == 1600 and {(r["z"], r["confidence"]) for r in got} == {(15.0, 255)}
    few = p.surface_run(pts.filter("east < 2"), ground, 1.0, 100.0).first()
    assert few["z"] == 10.0  # too few cells to tell


def test_series_and_results_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("a", 2.0, [1.0] * 9, [1.0, 2.0, 3.0]), ("a", 1.0, [0.5] * 9, [0.0, 0.0, 0.0])], "run_id string, t_s double, rotation array<double>, translation array<double>")
    back = p.series_from_json(p.series_to_json(nodes, scale=1.01)).orderBy("t_s").collect()
    assert [(r["t_s"], r["rotation"][0], r["translation"][1], r["mirror_z"], r["scale"]) for r in back] == [(1.0, 0.5, 0.0, False, 1.01), (2.0, 1.0, 2.0, False, 1.01)]
    bare = spark.createDataFrame([("b", '{"times":[1.0],"rotations":[[1,0,0,0,1,0,0,0,1]],"translations":[[0,0,0]]}')], "run_id string, value string")
    assert p.series_from_json(bare).select("mirror_z", "scale").first()[:] == (False, 1.0)
    p.write_results(nodes, f"{tmp_path}/r")
    assert spark.read.parquet(f"{tmp_path}/r/parquet").count() == 2
    assert json.loads(spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/r/csv").filter("t_s = 2.0").first()["translation"]) == [1.0, 2.0, 3.0]
    pts = spark.createDataFrame([(1, 2.0, 3.0, 39.123456789123, 45.0)], "id long, x double, y double, lon double, lat double")
    p.write_control_points(pts, f"{tmp_path}/g")
    assert spark.read.option("header", True).csv(f"{tmp_path}/g").first()["lon"] == "39.123456789"


def test_configurations_and_geoid(spark, tmp_path):
    ok = {"crs": "x", "zoom": {"max": 18}, "bounds": {"west": 1, "east": 2, "south": 1, "north": 2}}
    p.check_config(ok, {"crs": str, "zoom.max": int})
    for bad, need in ((ok, {"zoom.min": int}), (ok, {"crs": int}), (ok | {"bounds": {"west": 3, "east": 2, "south": 1, "north": 2}}, {"crs": str})):
        with pytest.raises(ValueError):
            p.check_config(bad, need)
    with pytest.raises(ValueError, match="no geoid"):
        p.geoid_grid(spark, None)
    spark.createDataFrame([], "i long, j long, v double").write.parquet(f"{tmp_path}/e")
    with pytest.raises(ValueError, match="empty"):
        p.geoid_grid(spark, f"{tmp_path}/e")


def test_refined_fixes_replace_coarse_ones(spark):
    refined = spark.createDataFrame([(1, 2.0, -4.0, 0.1, True, 1.0, 0.0, 0.0, 1.0, 0.0, 0.01), (2, 9.0, 9.0, 0.0, False, 1.0, 0.0, 0.0, 1.0, 0.0, 0.01)], "id long, dx double, dy double, yaw double, converged boolean, cov_ee double, cov_en double, cov_ey double, cov_nn double, cov_ny double, cov_yy double")
    fix = p.refined_fix(refined, 0.5, bias_m=1.0, floor_m=0.0, floor_rad=0.0)
    r = fix.filter("id = 1").first()
    assert (r["delta_east"], r["delta_north"], r["delta_yaw"], r["cov_ee"]) == (1.0, -2.0, pytest.approx(-0.1), pytest.approx(1.25))
    coarse = spark.createDataFrame([(1, 7.0, 7.0, 0.0), (2, 8.0, 8.0, 0.0), (3, 6.0, 6.0, 0.0)], "id long, delta_east double, delta_north double, delta_yaw double")
    got = {r["id"]: (r["delta_east"], r["refined"]) for r in p.best_fix(coarse, fix, ["id"]).collect()}
    assert got == {1: (1.0, True), 2: (8.0, False), 3: (6.0, False)}


def test_map_tiles_are_placed(spark):
    """One tile of four quarters under a grid about its middle; cells of a tile that is missing are not valid."""
    from plumbline.functions import geodesy

    z, (x, y) = 15, (19947, 11822)
    centre = spark.range(1).select(geodesy.tile_center(F.lit(x), F.lit(y), F.lit(z)).alias("c")).select(geodesy.utm(F.radians("c.lat"), F.radians("c.lon"), 37).alias("u")).first()["u"]
    grid = spark.range(20 * 20).select(F.floor(F.col("id") / 20).alias("r"), (F.col("id") % 20).alias("c")).withColumns({"easting": centre["easting"] + (F.col("c") - 9.5) * 20, "northing": centre["northing"] - (F.col("r") - 9.5) * 20})
    px = spark.range(256 * 256).select(F.lit(x).alias("x"), F.lit(y).alias("y"), F.floor(F.col("id") / 256).alias("r"), (F.col("id") % 256).alias("c")).withColumn("v", F.when(F.col("r") < 128, 10.0).otherwise(30.0) + F.when(F.col("c") < 128, 0.0).otherwise(5.0))
    got = {(r["r"], r["c"]): (r["v"], r["valid"]) for r in p.place_tiles(grid, spark.createDataFrame([(x, y, "ok")], "x int, y int, state string"), px, 37, z).collect()}
    assert [got[k] for k in ((2, 2), (2, 17), (17, 2), (17, 17))] == [(10.0, 255), (15.0, 255), (30.0, 255), (35.0, 255)]
    none = p.place_tiles(grid, spark.createDataFrame([(x, y, "placeholder")], "x int, y int, state string"), px, 37, z)
    assert {(r["v"], r["valid"]) for r in none.collect()} == {(0.0, 0)}


def test_semantic_layer_paints_in_order(spark):
    node = lambda i, x, y: {"type": "node", "id": i, "lat": float(y), "lon": float(x)}
    square = [node(1, 0, 0), node(2, 10, 0), node(3, 10, 10), node(4, 0, 10)]
    ways = [{"type": "way", "id": 9, "nodes": [1, 2, 3, 4, 1], "tags": {"landuse": "farmland"}}, {"type": "way", "id": 8, "nodes": [5, 6], "tags": {"highway": "track"}}]
    doc = json.dumps({"elements": square + [node(5, -3, 5), node(6, 14, 5)] + ways})
    got = {(r["r"], r["c"]): r["class"] for r in p.semantic_layer(spark.createDataFrame([(doc,)], "value string"), lambda lon, lat: (lon, lat), 1.0).collect()}
    assert got[0, 0] == 4 and got[9, 9] == 4 and got[5, 5] == 1 and got[5, 13] == 1 and (20, 20) not in got


def test_windows_of_requests(spark):
    levels = spark.createDataFrame([(0, 0.5, 0.0, 100.0, 200, 200), (1, 1.0, 0.0, 100.0, 100, 100), (2, 2.0, 0.0, 100.0, 50, 50)], "level long, gsd double, origin_east double, origin_north double, width long, height long")
    asked = spark.createDataFrame([(1, 50.0, 50.0, 10.0, 1.2), (2, 50.0, 50.0, 10.0, 0.1), (3, 2.0, 98.0, 10.0, 9.0), (4, -5.0, 50.0, 10.0, 1.0), (5, 100.0, 0.0, 10.0, 1.0)], "id long, east double, north double, radius_m double, gsd double")
    got = {r["id"]: r for r in windows.serve(asked, levels).collect()}
    assert (got[1]["level"], got[1]["x0"], got[1]["y0"], got[1]["w"], got[1]["corner_north"]) == (1, 40, 40, 20, 60.0)
    assert got[2]["level"] == 0 and got[3]["level"] == 2 and (got[3]["x0"], got[3]["y0"]) == (0, 0) and got[3]["w"] == 6
    assert not got[4]["success"] and "outside" in got[4]["message"] and got[5]["success"]
    answers = windows.requests_for(spark.createDataFrame([(1, 0.0), (2, 0.0), (3, 0.0)], "id long, t_s double"), spark.createDataFrame([(1, 0.15), (1, 0.1), (2, 0.4)], "id long, t_s double"))
    assert {r["id"]: (r["answered"], r["late"]) for r in answers.collect()} == {1: (0.1, False), 2: (None, True), 3: (None, True)}
