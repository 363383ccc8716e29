"""Queries of the dense kernels; where there is no SQL, tests hold them against analytic cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import kernels as k
from .tools import add


def _pairs(p: DataFrame) -> DataFrame:
    p = p.withColumn("v", F.col("v").cast("double"))
    moved = p.withColumn("c", F.pmod(F.col("c") + 2, F.lit(8)))
    return k.image_pairs(p, moved)


def _clouds(f: DataFrame) -> DataFrame:
    return f.select("run_id", F.col("gt_east").alias("ax"), F.col("gt_north").alias("ay"), F.col("latency_ms").alias("az"), F.col("est_east").alias("bx"), F.col("est_north").alias("by"), F.col("latency_ms").alias("bz"))


add("n17_n20_match_images", "pixels", lambda p: k.match_images(_pairs(p)), None, digits=4)
add("n22_refine_motion", "pixels", lambda p: k.refine_shift(_pairs(p), 5), None, digits=3)
def _eigenvalues_sql(source: str) -> str:
    """Eigenvalues e1 >= e2 >= e3 of symmetric 3 x 3 matrices (xx, yy, zz, xy, xz, yz), by the roots of the cubic; all columns stay."""
    return f"""(SELECT *, m + 2 * p * cos(phi) AS e1, 3 * m - (m + 2 * p * cos(phi)) - (m + 2 * p * cos(phi + 2 * pi() / 3)) AS e2, m + 2 * p * cos(phi + 2 * pi() / 3) AS e3 FROM
 (SELECT *, acos(greatest(-1e0, least(1e0, ((xx - m) * ((yy - m) * (zz - m) - yz * yz) - xy * (xy * (zz - m) - yz * xz) + xz * (xy * yz - (yy - m) * xz)) / (2 * p * p * p)))) / 3 AS phi FROM
 (SELECT *, sqrt(((xx - m) * (xx - m) + (yy - m) * (yy - m) + (zz - m) * (zz - m) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM (SELECT *, (xx + yy + zz) / 3 AS m FROM {source}) u) v) w)"""


AXES = (("x", "gt_east", "est_east"), ("y", "gt_north", "est_north"), ("z", "latency_ms", "latency_ms"))
CROSS = ", ".join(f"covar_pop({p}, {q}) AS c{i}{j}" for i, p, _ in AXES for j, _, q in AXES)
SQUARED = ", ".join(f"{' + '.join(f'c{k}{i} * c{k}{j}' for k, *_ in AXES)} AS {i}{j}" for i, j in (("x", "x"), ("y", "y"), ("z", "z"), ("x", "y"), ("x", "z"), ("y", "z")))
DETERMINANT = "cxx * (cyy * czz - cyz * czy) - cxy * (cyx * czz - cyz * czx) + cxz * (cyx * czy - cyy * czx)"
SIZE = " + ".join(f"var_pop({c})" for _, p, q in AXES for c in (p, q))
RIGID = f"""WITH s AS (SELECT run_id, CAST(floor(latency_ms / 20) AS BIGINT) AS "window", count(*) AS n, {SIZE} AS size, {CROSS} FROM fixes GROUP BY 1, 2 HAVING count(*) >= 3),
 q AS (SELECT run_id, "window", n, size, {DETERMINANT} AS det, {SQUARED} FROM s)
 SELECT run_id, "window", n, sqrt(greatest(0, size - 2 * (sqrt(greatest(e1, 0)) + sqrt(greatest(e2, 0)) + sign(det) * sqrt(greatest(e3, 0))))) AS rms FROM {_eigenvalues_sql("q")} r"""
add("n01_rigid_fit_windows", "fixes", lambda f: k.fit_rigid3(_clouds(f).withColumn("window", F.floor(F.col("az") / 20)), ["run_id", "window"]).select("run_id", "window", "n", "rms"), RIGID, "rms", 'run_id, "window", n', 4)
add("a37_a38_principal_axes", "fixes", lambda f: k.principal_axes(f.select("run_id", F.col("gt_east").alias("x"), F.col("gt_north").alias("y"), F.col("latency_ms").alias("z")), ["run_id"]).select("run_id", "n", F.element_at("sigma", 1).alias("s1"), F.element_at("sigma", 2).alias("s2"), F.element_at("sigma", 3).alias("s3")), f"""WITH s AS (SELECT run_id, count(*) AS n, var_pop(gt_east) AS xx, var_pop(gt_north) AS yy, var_pop(latency_ms) AS zz, covar_pop(gt_east, gt_north) AS xy, covar_pop(gt_east, latency_ms) AS xz, covar_pop(gt_north, latency_ms) AS yz FROM fixes GROUP BY run_id)
 SELECT run_id, n, sqrt(e1) AS s1, sqrt(e2) AS s2, sqrt(e3) AS s3 FROM {_eigenvalues_sql("s")} r""", "s1, s2, s3", "run_id, n", 5)
