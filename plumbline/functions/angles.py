"""Angles, planar poses and errors as Column functions.  Yaw is in radians from East, counter-clockwise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi


def position_error(east: Column, north: Column) -> Column:
    """Length of a planar error."""
    return F.hypot(east, north)


def normalize(a: Column) -> Column:
    """To (-pi, pi]."""
    r = a - F.lit(TWO_PI) * F.rint(a / TWO_PI)
    return F.when(r <= -math.pi, F.lit(math.pi)).otherwise(r)


def normalize_half_open(a: Column) -> Column:
    """To [-pi, pi)."""
    return F.pmod(a + F.lit(math.pi), F.lit(TWO_PI)) - F.lit(math.pi)


def angle_diff(a: Column, b: Column) -> Column:
    """Signed difference a - b in (-pi, pi]."""
    return normalize(a - b)


def yaw_error_deg(est: Column, truth: Column) -> Column:
    """Absolute wrapped difference in degrees."""
    d = est - truth
    return F.abs(F.degrees(F.atan2(F.sin(d), F.cos(d))))


def lateral_error(east: Column, north: Column, yaw: Column) -> Column:
    """Absolute component across the heading."""
    return F.abs(north * F.cos(yaw) - east * F.sin(yaw))


def circular_mean(a: Column) -> Column:
    """Aggregate: mean direction, 0 for no rows or a zero resultant."""
    s, c = F.sum(F.sin(a)), F.sum(F.cos(a))
    return F.when(s.isNull() | ((F.abs(s) < 1e-15) & (F.abs(c) < 1e-15)), F.lit(0.0)).otherwise(F.atan2(s, c))


def pose(x: Column, y: Column, yaw: Column) -> Column:
    """A planar pose as a struct."""
    return F.struct(x.alias("x"), y.alias("y"), normalize(yaw).alias("yaw"))


def compose(a: Column, b: Column) -> Column:
    """Pose b, given in the frame of pose a."""
    c, s = F.cos(a["yaw"]), F.sin(a["yaw"])
    return pose(a["x"] + c * b["x"] - s * b["y"], a["y"] + s * b["x"] + c * b["y"], a["yaw"] + b["yaw"])


def inverse(a: Column) -> Column:
    """The pose that undoes a."""
    c, s = F.cos(a["yaw"]), F.sin(a["yaw"])
    return pose(-(c * a["x"] + s * a["y"]), s * a["x"] - c * a["y"], -a["yaw"])


def between(a: Column, b: Column) -> Column:
    """Pose b seen from pose a."""
    return compose(inverse(a), b)


def apply_pose(a: Column, x: Column, y: Column) -> Column:
    """A point of a's frame in the outer frame."""
    c, s = F.cos(a["yaw"]), F.sin(a["yaw"])
    return F.struct((a["x"] + c * x - s * y).alias("x"), (a["y"] + s * x + c * y).alias("y"))


def log_pose(a: Column) -> Column:
    """Tangent vector (vx, vy, yaw) of a pose."""
    half = a["yaw"] / 2
    v = F.when(F.abs(a["yaw"]) < 1e-9, F.lit(1.0)).otherwise(half / F.tan(half))
    return F.struct((v * a["x"] + half * a["y"]).alias("x"), (v * a["y"] - half * a["x"]).alias("y"), a["yaw"].alias("yaw"))
