"""Synthetic data as Column expressions: pair specifications, patches, augmentation, clouds, ray marching.

Random draws are hashes of a row's id, a draw number and a seed, so a row is the same wherever
and however often it is made.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import angles, imaging

#: Named sets: number of pairs, largest offset (m) and yaw difference (degrees).
PRESETS = {"smoke": (20, 20.0, 5.0), "regression": (3000, 40.0, 10.0), "stress": (1000, 80.0, 30.0)}


def uniform(key: Column, draw: int, seed: int, low: float = 0.0, high: float = 1.0) -> Column:
    """A number in [low, high) per row and draw."""
    h = F.xxhash64(key, F.lit(draw), F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1))
    return low + (high - low) * (h / float(1 << 53))


def normal(key: Column, draw: int, seed: int, sigma: float = 1.0) -> Column:
    """A Gaussian draw from two uniform ones."""
    u = F.greatest(uniform(key, 2 * draw, seed), F.lit(1e-12))
    return sigma * F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * uniform(key, 2 * draw + 1, seed))


def region(bounds: DataFrame, margin: float) -> DataFrame:
    """Sampling rectangle of points (east, north), shrunk by a margin."""
    return bounds.agg((F.min("east") + margin).alias("east_min"), (F.max("east") - margin).alias("east_max"), (F.min("north") + margin).alias("north_min"), (F.max("north") - margin).alias("north_max"))


def pair_specs(ids: DataFrame, preset: str = "smoke", span: float = 500.0, seed: int = 0, providers: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """A specification per id: true pose, prior pose, their difference, two different providers, gamma and haze.

    A pair of one provider is an error, both for ``providers`` and for a row that would have one.
    """
    if len(set(providers)) < 2 or len(set(providers)) < len(providers):
        raise ValueError("query and map must be of different providers")
    _, offset, yaw = PRESETS[preset]
    k = F.col("id")
    n = len(providers)
    first = F.floor(uniform(k, 6, seed) * n).cast("int")
    names = F.array(*map(F.lit, providers))
    df = ids.select("id", *(c.alias(a) for a, c in (
        ("gt_east", uniform(k, 0, seed, -span, span)), ("gt_north", uniform(k, 1, seed, -span, span)), ("gt_yaw", uniform(k, 2, seed, -math.pi, math.pi)),
        ("off_east", uniform(k, 3, seed, -offset, offset)), ("off_north", uniform(k, 4, seed, -offset, offset)), ("off_yaw", uniform(k, 5, seed, -math.radians(yaw), math.radians(yaw))),
        ("gamma", uniform(k, 7, seed, 0.8, 1.25)), ("haze", uniform(k, 8, seed, 0.0, 0.2)),
    )), names[first].alias("query_provider"), names[(first + 1) % n].alias("map_provider"))
    df = df.withColumns({"prior_east": F.col("gt_east") + F.col("off_east"), "prior_north": F.col("gt_north") + F.col("off_north"), "prior_yaw": F.col("gt_yaw") + F.col("off_yaw")})
    return pair_delta(df.withColumn("map_provider", cross_provider(F.col("query_provider"), F.col("map_provider"))))


def cross_provider(query: Column, map_: Column) -> Column:
    """The map's provider; an error where it is the query's."""
    return F.when(query != map_, map_).otherwise(F.raise_error(F.concat(F.lit("query and map are of one provider: "), F.coalesce(query, F.lit("null")))))


def pair_delta(specs: DataFrame) -> DataFrame:
    """Add delta_east, delta_north and delta_yaw, true pose less prior pose, the heading wrapped."""
    d = lambda a: F.col(f"gt_{a}") - F.col(f"prior_{a}")
    return specs.withColumns({"delta_east": d("east"), "delta_north": d("north"), "delta_yaw": angles.normalize(d("yaw"))})


def terrain_counts(pairs: DataFrame, terrain: str = "terrain") -> DataFrame:
    """Pairs per terrain class; those without one count as background."""
    return pairs.groupBy(F.coalesce(terrain, F.lit("background")).alias("terrain")).agg(F.count("*").alias("n"))


def patch_grid(specs: DataFrame, size: int, gsd: float, east: str = "gt_east", north: str = "gt_north", yaw: str = "gt_yaw") -> DataFrame:
    """A row per pixel: r, c and where its centre is on the ground, rows going south in the patch's frame."""
    cells = specs.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    dx, dy = (F.col("c") + 0.5 - size / 2) * gsd, (size / 2 - F.col("r") - 0.5) * gsd
    cy, sy = F.cos(yaw), F.sin(yaw)
    return cells.withColumns({"east": F.col(east) + cy * dx - sy * dy, "north": F.col(north) + sy * dx + cy * dy})


def render(grid: DataFrame, kind: str, seed: int = 0, second: bool = False) -> DataFrame:
    """Colours of the pixels of a synthetic scene."""
    return grid.withColumn("rgb", imaging.texture(kind, F.col("east"), F.col("north"), seed, second))


def augment(pixels: DataFrame, params: dict[str, float], seed: int = 0) -> DataFrame:
    """Photometric changes of v in a fixed order: gamma, contrast, haze, snow, noise; unknown names are an error."""
    known = ("gamma", "contrast", "haze", "snow", "noise")
    if set(params) - set(known):
        raise ValueError(f"unknown augmentations: {sorted(set(params) - set(known))}")
    v, key = F.col("v"), F.struct("id", "r", "c")
    if "gamma" in params:
        v = imaging.gamma(v, params["gamma"])
    if "contrast" in params:
        v = imaging.contrast(v, params["contrast"])
    if "haze" in params:
        v = imaging.haze(v, params["haze"])
    if "snow" in params:
        v = F.when(uniform(key, 0, seed) < params["snow"], 235.0 + 20.0 * uniform(key, 1, seed)).otherwise(v)
    if "noise" in params:
        v = imaging.clip(v + normal(key, 2, seed, params["noise"]))
    return pixels.withColumn("v", v)


def march(start: tuple[Column, Column, Column], ray: tuple[Column, Column, Column], height: Callable[[Column, Column], Column], reach: float, steps: int = 64, halvings: int = 8) -> Column:
    """Distance along a ray at which it meets a height function; null if it doesn't within ``reach``.

    Equal steps bracket the first crossing, halving refines it; both are folds in one expression.
    """
    (x, y, z), (dx, dy, dz) = start, ray
    below = lambda s: z + s * dz <= height(x + s * dx, y + s * dy)
    size = reach / steps

    def step(found: Column, i: Column) -> Column:
        s = i.cast("double") * size
        return F.when(found.isNotNull(), found).when(below(s), s)

    first = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(None).cast("double"), step)

    def halve(b: Column, _: Column) -> Column:
        mid = (b["lo"] + b["hi"]) / 2
        hit = below(mid)
        return F.struct(F.when(hit, b["lo"]).otherwise(mid).alias("lo"), F.when(hit, mid).otherwise(b["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(halvings)), F.struct((first - size).alias("lo"), first.alias("hi")), halve)["hi"]


def cloud(poses: DataFrame, points: int, half_fov: tuple[float, float] = (0.61, 0.67), noise_m: float = 0.02, dropout: float = 0.05, ground: float = 0.0, seed: int = 0) -> DataFrame:
    """Points (id, i, east, north, up) that a downward scanner at each pose (id, east, north, up) would see on flat ground.

    Rays fill a rectangle of the view; a share is dropped and ranges are noisy.
    """
    rays = poses.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    key = F.struct("id", "i")
    ax, ay = uniform(key, 0, seed, -half_fov[0], half_fov[0]), uniform(key, 1, seed, -half_fov[1], half_fov[1])
    rays = rays.filter(uniform(key, 2, seed) >= dropout).withColumns({"tx": F.tan(ax), "ty": F.tan(ay)})
    range_ = (F.col("up") - ground) * F.sqrt(1 + F.col("tx") * F.col("tx") + F.col("ty") * F.col("ty"))
    k = (range_ + normal(key, 3, seed, noise_m)) / F.sqrt(1 + F.col("tx") * F.col("tx") + F.col("ty") * F.col("ty"))
    return rays.select("id", "i", (F.col("east") + k * F.col("tx")).alias("e"), (F.col("north") + k * F.col("ty")).alias("n"), (F.col("up") - k).alias("u")).withColumnsRenamed({"e": "east", "n": "north", "u": "up"})


def grid_descriptors(pixels: DataFrame, patch: int = 8) -> DataFrame:
    """Per patch of ``patch`` x ``patch`` pixels: its centre and +1 or -1 for each pixel against the patch's mean."""
    p = pixels.withColumns({"pr": F.floor(F.col("r") / patch), "pc": F.floor(F.col("c") / patch)})
    g = p.groupBy("image", "pr", "pc").agg(F.avg("v").alias("mean"), F.transform(F.array_sort(F.collect_list(F.struct("r", "c", "v"))), lambda x: x["v"]).alias("v"))
    bits = F.transform("v", lambda v: F.when(v > F.col("mean"), 1).otherwise(-1).cast("tinyint"))
    return g.select("image", ((F.col("pc") + 0.5) * patch).alias("x"), ((F.col("pr") + 0.5) * patch).alias("y"), bits.alias("descriptor"))
