"""Sessions of fixes in batch and stream, and chi-square quantiles."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import chi_square
from plumbline.operators import outages

#: Fixed values of the chi-square distribution: dof, share, quantile (published tables).
TABLE = [(1, 0.95, 3.841458820694124), (2, 0.95, 5.991464547107979), (3, 0.99, 11.344866730144373), (10, 0.025, 3.246972780236842), (100, 0.975, 129.56119718583659), (1, 0.05, 0.00393214000001952)]


def test_quantiles_are_those_of_the_tables(spark):
    for dof, p, want in TABLE:
        got = chi_square.quantiles(spark.createDataFrame([(dof,)], "dof int"), "dof", {"q": p}).first()["q"]
        assert got == pytest.approx(want, rel=1e-8)


def test_quantiles_undo_the_distribution(spark):
    dofs = spark.range(1, 301).withColumnRenamed("id", "dof")
    shares = {"a": 0.001, "b": 0.025, "c": 0.5, "d": 0.975, "e": 0.999}
    q = chi_square.quantiles(dofs, "dof", shares)
    back = q.select("dof", *(chi_square.cdf(F.col(n), F.col("dof").cast("double")).alias(n) for n in shares)).collect()
    assert len(back) == 300 and all(r[n] == pytest.approx(p, rel=1e-8) for r in back for n, p in shares.items())
    two = {r["dof"]: r["c"] for r in q.collect()}[2]
    assert two == pytest.approx(2 * math.log(2), rel=1e-12)
    none = chi_square.quantiles(spark.createDataFrame([(0,), (None,)], "dof int"), "dof", {"q": 0.5})
    assert [r["q"] for r in none.collect()] == [None, None]


FIXES = [("a", t, 10.0 * t, t in (0, 2, 107, 300)) for t in (0, 1, 2, 3, 100, 107, 110, 300, 301)] + [("b", 5, 0.0, False), ("b", 400, 5000.0, False)]


def fixes(spark):
    return spark.createDataFrame(FIXES, "run_id string, t long, path_m double, nominal boolean").withColumn("ts", F.timestamp_seconds("t")).drop("t")


def test_recovery_after_outages(spark):
    spans = outages.sessions(fixes(spark), 50.0).cache()
    assert sorted((r["run_id"], r["n"]) for r in spans.collect()) == [("a", 2), ("a", 3), ("a", 4), ("b", 1), ("b", 1)]
    got = sorted((r["run_id"], r["outage_m"], r["recovery_s"]) for r in outages.recoveries(spans, 1000.0).collect())
    assert got == [("a", 1900.0, 0.0), ("b", 5000.0, None)]
    assert sorted((r["outage_m"], r["recovery_s"]) for r in outages.recoveries(spans, 0.0).filter("run_id = 'a'").collect()) == [(970.0, 7.0), (1900.0, 0.0)]


def test_sessions_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    rows = fixes(spark).unionByName(spark.createDataFrame([("z", 0.0, False, 9000)], "run_id string, path_m double, nominal boolean, t long").select("run_id", "path_m", "nominal", F.timestamp_seconds("t").alias("ts")))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = outages.sessions(stream, 50.0, "1 second").writeStream.format("memory").queryName("spans").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert not query.isActive
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, spark.table("spans").collect())) == sorted(map(key, outages.sessions(fixes(spark), 50.0).collect()))


def test_density_and_growth(spark):
    df = spark.createDataFrame([("a", 1, 0.0, True, True, 1.0), ("a", 2, 500.0, True, True, 2.0), ("a", 3, 2000.0, False, True, 1.5), ("a", 4, 4000.0, True, False, 0.1), ("s", 1, 7.0, True, True, 1.0)], "run_id string, ord long, path_m double, accepted boolean, coasting boolean, sigma double")
    assert {r["run_id"]: r["fixes_per_km"] for r in outages.fixes_per_km(df).collect()} == {"a": 0.75, "s": None}
    assert {r["run_id"]: (r["falls"], r["monotone"]) for r in outages.growing_covariance(df).collect()} == {"a": (1, False), "s": (0, True)}
