"""Distances, surfaces and fixes of class masks against plain loops."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import semantic


def test_distances_are_exact(spark):
    rng = np.random.default_rng(6)
    masks = {0: rng.random((17, 23)) < 0.05, 1: rng.random((9, 30)) < 0.5, 2: np.zeros((4, 4), bool), 3: np.eye(12, dtype=bool)}
    rows = [(i, r, c, bool(m[r, c])) for i, m in masks.items() for r in range(m.shape[0]) for c in range(m.shape[1])]
    got = {(x["image"], x["r"], x["c"]): x["d2"] for x in semantic.distances(spark.createDataFrame(rows, "image long, r long, c long, on boolean").repartition(5)).collect()}
    assert len(got) == len(rows)
    for i, m in masks.items():
        on = np.argwhere(m)
        for r in range(m.shape[0]):
            for c in range(m.shape[1]):
                want = None if not len(on) else int(((on - [r, c]) ** 2).sum(1).min())
                assert got[i, r, c] == want


def test_a_known_shift_comes_back(spark):
    rng = np.random.default_rng(7)
    masks = {k: np.kron(rng.random((10, 10)) < 0.3, np.ones((3, 3), bool)) for k in (1, 3, 4)}
    cells = lambda m, dr=0, dc=0: spark.createDataFrame([(0, int(r) + dr, int(c) + dc) for r, c in np.argwhere(m)], "image long, r long, c long")
    made = None
    for k, m in masks.items():
        one = semantic.overlap_surface(cells(m), cells(m, 2, -1), 3).withColumn("class", F.lit(k))
        made = one if made is None else made.unionByName(one)
    fix = semantic.semantic_fix(made).first()
    assert (fix["dr"], fix["dc"], fix["score"], fix["classes"], fix["confident"], fix["fix_type"]) == (-2, 1, pytest.approx(1.0), 3, True, 2) and fix["sharpness"] > 1.5
    farm = semantic.semantic_fix(made.filter("class = 4")).first()
    assert (farm["dr"], farm["dc"], farm["confident"], farm["fix_type"]) == (-2, 1, False, 2)
    full = spark.createDataFrame([(0, r, c, bool(masks[1][r, c])) for r in range(30) for c in range(30)], "image long, r long, c long, on boolean")
    chamfer = semantic.chamfer_surface(full, cells(masks[1], 2, -1), 3).orderBy("chamfer", F.desc("n")).first()
    assert (chamfer["dr"], chamfer["dc"], chamfer["chamfer"]) == (-2, 1, 0.0)
