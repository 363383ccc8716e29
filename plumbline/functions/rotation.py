"""Quaternions (w, x, y, z) and rotations as Column functions over structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = ("w", "x", "y", "z")


def quaternion(w: Column, x: Column, y: Column, z: Column) -> Column:
    return F.struct(w.alias("w"), x.alias("x"), y.alias("y"), z.alias("z"))


def _norm(q: Column) -> Column:
    return F.sqrt(q["w"] * q["w"] + q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"])


def unit(q: Column) -> Column:
    n = _norm(q)
    return quaternion(*(q[p] / n for p in PARTS))


def to_matrix(q: Column) -> Column:
    """Row-major array of nine."""
    n = _norm(q)
    w, x, y, z = (q[p] / n for p in PARTS)
    return F.array(
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    )


def from_matrix(m: Column) -> Column:
    """Quaternion of a row-major rotation; the largest of the four parts is solved first."""
    g = lambda i, j: m[3 * i + j]
    trace = g(0, 0) + g(1, 1) + g(2, 2)
    s0 = F.sqrt(trace + 1) * 2
    s1 = F.sqrt(1 + g(0, 0) - g(1, 1) - g(2, 2)) * 2
    s2 = F.sqrt(1 + g(1, 1) - g(0, 0) - g(2, 2)) * 2
    s3 = F.sqrt(1 + g(2, 2) - g(0, 0) - g(1, 1)) * 2
    q0 = quaternion(s0 / 4, (g(2, 1) - g(1, 2)) / s0, (g(0, 2) - g(2, 0)) / s0, (g(1, 0) - g(0, 1)) / s0)
    q1 = quaternion((g(2, 1) - g(1, 2)) / s1, s1 / 4, (g(0, 1) + g(1, 0)) / s1, (g(0, 2) + g(2, 0)) / s1)
    q2 = quaternion((g(0, 2) - g(2, 0)) / s2, (g(0, 1) + g(1, 0)) / s2, s2 / 4, (g(1, 2) + g(2, 1)) / s2)
    q3 = quaternion((g(1, 0) - g(0, 1)) / s3, (g(0, 2) + g(2, 0)) / s3, (g(1, 2) + g(2, 1)) / s3, s3 / 4)
    return F.when(trace > 0, q0).when((g(0, 0) > g(1, 1)) & (g(0, 0) > g(2, 2)), q1).when(g(1, 1) > g(2, 2), q2).otherwise(q3)


def slerp(a: Column, b: Column, t: Column) -> Column:
    """Shortest-path interpolation; linear and renormalised where the two nearly agree."""
    na, nb = _norm(a), _norm(b)
    dot = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), sum((a[p] * b[p] for p in PARTS[1:]), a["w"] * b["w"]) / (na * nb)))
    sign = F.when(dot < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    d = F.abs(dot)
    th = F.acos(F.least(d, F.lit(0.9995)))
    near = d > 0.9995
    k0 = F.when(near, 1 - t).otherwise(F.sin((1 - t) * th) / F.sin(th))
    k1 = F.when(near, t).otherwise(F.sin(t * th) / F.sin(th)) * sign
    mixed = quaternion(*(k0 * a[p] / na + k1 * b[p] / nb for p in PARTS))
    n = F.when(near, _norm(mixed)).otherwise(F.lit(1.0))
    return quaternion(*(mixed[p] / n for p in PARTS))


def rotate(m: Column, x: Column, y: Column, z: Column) -> Column:
    """A row-major rotation applied to a vector."""
    return F.struct(*((m[3 * i] * x + m[3 * i + 1] * y + m[3 * i + 2] * z).alias(n) for i, n in enumerate("xyz")))


def heading3(a: Column) -> Column:
    """Rotation about the vertical, row-major 3x3."""
    o, i = F.lit(0.0), F.lit(1.0)
    return F.array(F.cos(a), -F.sin(a), o, F.sin(a), F.cos(a), o, o, o, i)


def heading2(a: Column) -> Column:
    return F.array(F.cos(a), -F.sin(a), F.sin(a), F.cos(a))


def heading2_rate(a: Column) -> Column:
    """Derivative of ``heading2`` by the angle."""
    return F.array(-F.sin(a), -F.cos(a), F.cos(a), -F.sin(a))
