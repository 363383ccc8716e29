"""Camera frames and terrain: ray marching, backward warping, rendering and rectifying, as joins on cells.

Terrain is a table of cells (r, c, z, lidar) of ``cell`` metres: r counts north, c east, lidar
tells measured heights from filled ones.  Frames are rows (image, cx, cy, cz, rot) with the
camera's position and its axes as the columns of a row-major rotation into the world; x goes
right, y down, z ahead.  No frame or terrain is ever whole in one place: a ray meets the
terrain at its steps, by equality of cells, or a part of the plane at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import imaging
from . import grids


@dataclass(frozen=True)
class Camera:
    """Pinhole with radial-tangential distortion and an image of ``width`` x ``height``."""

    fx: float
    fy: float
    cx: float
    cy: float
    width: int
    height: int
    lens: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)


def heights(points: DataFrame, terrain: DataFrame, cell: float, x: str = "x", y: str = "y") -> DataFrame:
    """Add tz and tl, the terrain's height and lidar at each point; null where there is none."""
    at = points.withColumns({"__r": F.floor(F.col(y) / cell), "__c": F.floor(F.col(x) / cell)})
    cells = terrain.select(F.col("r").alias("__r"), F.col("c").alias("__c"), F.col("z").cast("double").alias("tz"), F.col("lidar").cast("double").alias("tl"))
    return at.join(cells, ["__r", "__c"], "left").drop("__r", "__c")


#: Cells along the sides of the blocks whose greatest heights rays are held against, coarsest first; the last are the tiles.
BLOCKS = (256, grids.TILE)


def crests(terrain: DataFrame, size: int) -> DataFrame:
    """The greatest height (br, bc, top) of each block of ``size`` x ``size`` cells."""
    return terrain.groupBy(F.floor(F.col("r") / size).alias("br"), F.floor(F.col("c") / size).alias("bc")).agg(F.max(F.col("z").cast("double")).alias("top"))


def _first_below(rays: DataFrame, by: list[str], terrain: DataFrame, cell: float, parts: int, blocks: tuple[int, ...], name: str) -> DataFrame:
    """``rays`` (with lo and hi) and ``name``, the least k of 1..``parts`` at whose point, k parts of ``hi - lo`` past lo, the terrain is not lower.

    A ray is cut into runs of points in one block, coarse blocks first.  Of a run only the points
    no higher than the block's crest go on, and those in blocks without terrain go no further, so
    a ray has about a row a level (its first run stays to carry it).  At the last level a run
    meets its tile of heights.  Rays whose lo is null have no k.
    """
    along = lambda k, a: f"(o{a} + (lo + {k} * (hi - lo) / {parts}) * d{a})"
    cell_of = lambda k, a: f"floor({along(k, a)} / {cell!r}D)"
    base = [*by, "__ray", "ox", "oy", "oz", "dx", "dy", "dz", "lo", "hi", "first"]
    own = [c for c in rays.columns if c not in by]
    line = {c: F.col(c).cast("double") for c in base[len(by) + 1 : -1]}
    runs = rays.select(*by, F.struct(*own).alias("__ray"), *(c.alias(n) for n, c in line.items()), F.lit(True).alias("first"), F.expr("if(lo IS NULL, NULL, 1)").alias("k0"), F.lit(parts).alias("k1"))
    for size in blocks:
        block = lambda k, size=size: f"struct(floor({cell_of(k, 'y')} / {size}), floor({cell_of(k, 'x')} / {size}))"
        one = f"{block('k0')} = {block('k1')}"  # then all between are in it too: x and y go one way
        cut = f"""if({one}, array(struct(k0 AS `0`, k1 AS `1`)), arrays_zip(filter(sequence(k0, k1), k -> k = k0 OR {block('k')} <> {block('(k - 1)')}),
            filter(sequence(k0, k1), k -> k = k1 OR {block('k')} <> {block('(k + 1)')})))"""
        runs = runs.select(*base, F.posexplode_outer(F.expr(f"if(k0 IS NULL, NULL, {cut})")).alias("pos", "run"))
        runs = runs.select(*base[:-1], F.expr("first AND coalesce(pos, 0) = 0").alias("first"), F.col("run.`0`").alias("k0"), F.col("run.`1`").alias("k1"))
        runs = runs.withColumns({"br": F.expr(f"floor({cell_of('k0', 'y')} / {size})"), "bc": F.expr(f"floor({cell_of('k0', 'x')} / {size})")})
        if size != blocks[-1]:
            runs = runs.join(crests(terrain, size).withColumn("bottom", F.lit(None).cast("double")), ["br", "bc"], "left")
        else:
            tiles = grids.tiled(terrain.select("r", "c", F.col("z").cast("double").alias("z")), [], ["z"], size).withColumnsRenamed({"tr": "br", "tc": "bc"})
            whole = F.expr(f"w * h = {size * size} AND NOT exists(z, v -> v IS NULL)")
            runs = runs.join(tiles.withColumns({"top": F.array_max("z"), "bottom": F.when(whole, F.array_min("z"))}), ["br", "bc"], "left")
            base = [*base, "r0", "c0", "w", "h", "z"]
        # The points at or below the crest are those from, or up to, where the ray passes it; below all heights of a whole tile one is enough.
        at = lambda z: f"try_divide(try_divide({z} - oz, dz) - lo, hi - lo) * {parts}"
        trimmed = {
            "k0": f"if(dz < 0, greatest(k0, CAST(ceil({at('top')} - 1e-6) AS INT)), k0)",
            "k1": f"if(dz > 0, least(k1, CAST(floor({at('top')} + 1e-6) AS INT)), if(dz < 0, least(k1, greatest(k0, coalesce(CAST(ceil({at('bottom')}) AS INT) + 1, k1))), k1))",
        }
        runs = runs.select(*base, "top", *(F.expr(e).alias(c) for c, e in trimmed.items()))
        runs = runs.withColumn("live", F.expr("coalesce(k0 <= k1 AND (dz <> 0 OR oz <= top), false)")).filter("live OR first")
        runs = runs.select(*base, F.expr("if(live, k0, NULL)").alias("k0"), F.expr("if(live, k1, NULL)").alias("k1"))
    place = f"CAST(({cell_of('k', 'y')} - r0) * w + {cell_of('k', 'x')} - c0 AS INT)"
    inside = f"{cell_of('k', 'y')} BETWEEN r0 AND r0 + h - 1 AND {cell_of('k', 'x')} BETWEEN c0 AND c0 + w - 1"
    found = F.expr(f"array_min(filter(if(k0 IS NULL, NULL, sequence(k0, k1)), k -> {inside} AND {along('k', 'z')} <= get(z, {place})))")
    made = runs.select(*by, "__ray", found.alias("k")).groupBy(*by).agg(F.any_value("__ray").alias("__ray"), F.min("k").alias(name))
    return made.select(*by, "__ray.*", name)


def march(rays: DataFrame, by: list[str], terrain: DataFrame, cell: float, steps: int = 48, halvings: int = 6) -> DataFrame:
    """Add s and hit: how far along each ray the terrain is met, and whether it is.

    ``rays`` has the key ``by``, ox, oy, oz, dx, dy, dz, near and far.  Equal steps from near
    to far bracket the first point at or below the terrain; that step is cut in 2 to the
    ``halvings`` parts to refine it.  A ray that meets nothing ends at far.  Points over no
    terrain are not below it.  Rays skip the blocks whose crests they pass over.
    """
    rest = [c for c in rays.columns if c not in by]
    coarse = _first_below(rays.withColumns({"lo": F.col("near"), "hi": F.col("far")}), by, terrain, cell, steps, BLOCKS, "__coarse")
    step = (F.col("far") - F.col("near")) / steps
    lo = F.col("near") + (F.col("__coarse") - 1) * step
    parts = 1 << halvings
    met = _first_below(coarse.withColumns({"lo": lo, "hi": lo + step}), by, terrain, cell, parts, BLOCKS[-1:], "__fine")
    s = F.when(F.col("__coarse").isNull(), F.col("far")).otherwise(F.col("lo") + (F.coalesce("__fine", F.lit(parts)) - 0.5) * step / parts)
    return met.select(*by, *rest, s.alias("s"), F.col("__coarse").isNotNull().alias("hit"))


def _to_camera(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    d = (x - F.col("cx"), y - F.col("cy"), z - F.col("cz"))
    return tuple(sum((F.col("rot")[3 * i + j] * d[i] for i in range(1, 3)), F.col("rot")[j] * d[0]) for j in range(3))


def project(points: DataFrame, camera: Camera) -> DataFrame:
    """Add u and v, the pixel at which a frame sees a point (x, y, z); null behind the camera."""
    p = imaging.project(*_to_camera(F.col("x"), F.col("y"), F.col("z")), camera.fx, camera.fy, camera.cx, camera.cy, camera.lens)
    return points.withColumn("__p", p).withColumns({"u": F.col("__p.u"), "v": F.col("__p.v")}).drop("__p")


#: The least height above ground that a frame is taken to have.
LEAST = 30.0


def above_ground(frames: DataFrame, terrain: DataFrame, cell: float, least: float = LEAST, otherwise: float = 100.0) -> DataFrame:
    """Add agl, a frame's height above the terrain below it: ``least`` at least, ``otherwise`` over none."""
    at = heights(frames, terrain, cell, "cx", "cy")
    return at.withColumn("agl", F.coalesce(F.greatest(F.col("cz") - F.col("tz"), F.lit(least)), F.lit(otherwise))).drop("tz", "tl")


def patch(frames: DataFrame, size: int, gsd: float) -> DataFrame:
    """A row per pixel (r, c, x, y) of a square patch round each frame's position, rows going south."""
    n = F.sequence(F.lit(0), F.lit(size - 1))
    cells = frames.withColumn("r", F.explode(n)).withColumn("c", F.explode(n))
    return cells.withColumns({"x": F.col("cx") + (F.col("c") - size / 2 + 0.5) * gsd, "y": F.col("cy") - (F.col("r") - size / 2 + 0.5) * gsd})


#: Cells sideways beyond which a frame's rays are marched by joins; nearer ones have their terrain in one place, in squares of so many cells.
REACH = 512
#: Frames of a square in a task, about; and rays at a time there.
FRAMES, RAYS = 4000, 2000


def _in_parts(frames: DataFrame, terrain: DataFrame, cell: float, size: int, gsd: float, rounds: int, steps: int, bounds: tuple[float, float], halo: int, halvings: int = 6) -> DataFrame:
    """The pixels of frames whose rays stay within ``halo`` cells: a frame and, once, the terrain around its square are all that is shuffled."""
    own = frames.select(*(F.col(c).alias(c) for c in frames.columns)).withColumns({f"t{a}": F.floor(F.floor(F.col(f"c{b}") / cell) / REACH) for a, b in ("ry", "cx")})
    many = own.groupBy("tr", "tc").agg(F.ceil(F.count("*") / FRAMES).alias("parts"))
    asked = own.join(many, ["tr", "tc"]).withColumn("part", F.pmod(F.xxhash64("image"), F.col("parts"))).drop("parts")
    cells = grids._with_halo(terrain.select("r", "c", F.col("z").cast("double").alias("z"), F.col("lidar").cast("double").alias("lidar")), REACH, halo)
    sent = cells.join(many, ["tr", "tc"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    made = ["x", "y", "z", "lidar", "hit", "over"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema) + ", agl double, " + ", ".join(f"__{n} array<{'boolean' if n in ('hit', 'over') else 'double'}>" for n in made)
    names = frames.columns

    def kernel(key: tuple[int, int, int], at: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        corner = tuple(int(k) * REACH - halo for k in key[:2])
        place = tuple(near[a].to_numpy() - k for a, k in zip("rc", corner, strict=True))
        ground = np.full((2, *(REACH + 2 * halo,) * 2), np.nan)
        for field, c in zip(ground, ("z", "lidar"), strict=True):
            field[place] = near[c].to_numpy(float)
        camera = np.stack([at[c].to_numpy(float) for c in ("cx", "cy", "cz")])
        step = max(1, RAYS // (size * size))
        got = [_lay(camera[:, i : i + step], ground, corner, cell, size, gsd, rounds, steps, 1 << halvings, bounds) for i in range(0, len(at), step)]
        made_of = {n: [row for g in got for row in g[n]] for n in ("agl", *made)}
        return at[names].assign(agl=made_of.pop("agl"), **{f"__{n}": v for n, v in made_of.items()})

    laid = asked.groupBy("tr", "tc", "part").cogroup(sent.groupBy("tr", "tc", "part")).applyInPandas(kernel, schema)
    rows = laid.select(*names, "agl", F.posexplode(F.arrays_zip(*(f"__{n}" for n in made))).alias("__i", "__p"))
    return rows.select(*names, "agl", F.floor(F.col("__i") / size).cast("int").alias("r"), (F.col("__i") % size).alias("c"), *(F.col(f"__p.__{n}").alias(n) for n in made))


def _lay(camera: np.ndarray, ground: np.ndarray, corner: tuple[int, int], cell: float, size: int, gsd: float, rounds: int, steps: int, parts: int, bounds: tuple[float, float]) -> dict[str, np.ndarray]:
    """What ``_by_joins`` gives, a row a frame, over heights and lidar as arrays, NaN where there is none."""

    def look(field: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        r, c = np.floor(y / cell) - corner[0], np.floor(x / cell) - corner[1]
        inside = (r >= 0) & (c >= 0) & (r < field.shape[0]) & (c < field.shape[1])
        return np.where(inside, field[np.where(inside, r, 0).astype(np.int64), np.where(inside, c, 0).astype(np.int64)], np.nan)

    heights_, lidar_ = ground
    agl = np.fmax(camera[2] - look(heights_, camera[0], camera[1]), LEAST)
    rows, cols = (v.ravel() for v in np.meshgrid(np.arange(size), np.arange(size), indexing="ij"))
    o = np.repeat(camera, size * size, axis=1)
    high = np.repeat(agl, size * size)
    x = o[0] + (np.tile(cols, len(agl)) - size / 2 + 0.5) * gsd
    y = o[1] - (np.tile(rows, len(agl)) - size / 2 + 0.5) * gsd
    tz = look(heights_, x, y)
    z = np.where(np.isnan(tz), o[2] - high, tz)
    near, far = bounds[0] * high, bounds[1] * high
    step = (far - near) / steps

    def first(some: np.ndarray, d: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
        """The first of n points past lo at or below the terrain, 0 if there is none."""
        s = lo[some, None] + np.arange(1, n + 1) * (hi - lo)[some, None] / n
        px, py, pz = (o[i, some, None] + s * d[i, some, None] for i in range(3))
        below = pz <= look(heights_, px, py)
        k = np.zeros(len(some), np.int64)
        k[some] = np.where(below.any(axis=1), below.argmax(axis=1) + 1, 0)
        return k

    for _ in range(rounds):
        d = np.stack([x, y, z]) - o
        d = d / np.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
        k = first(np.ones(len(x), bool), d, near, far, steps)
        hit = k > 0
        lo = near + (k - 1) * step
        j = first(hit, d, lo, lo + step, parts)
        s = np.where(hit, lo + (np.where(j > 0, j, parts) - 0.5) * step / parts, far)
        x, y, z = o + s * d
        tz, tl = look(heights_, x, y), look(lidar_, x, y)
        z, lidar, over = np.where(np.isnan(tz), z, tz), np.where(np.isnan(tl), 0.0, tl), ~np.isnan(tz)
    made = {"x": x, "y": y, "z": z, "lidar": lidar, "hit": hit, "over": over}
    return {"agl": agl, **{n: v.reshape(len(agl), -1) for n, v in made.items()}}


def _by_joins(frames: DataFrame, terrain: DataFrame, cell: float, size: int, gsd: float, rounds: int, steps: int, bounds: tuple[float, float]) -> DataFrame:
    """The pixels of each frame's patch with the point that each sees, by rays that meet the terrain's tiles in joins: for any height."""
    by = ["image", "r", "c"]
    spread = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen = patch(above_ground(frames.repartition(spread, "image"), terrain, cell), size, gsd)
    seen = heights(seen, terrain, cell).withColumn("z", F.coalesce("tz", F.col("cz") - F.col("agl"))).drop("tz", "tl")
    for _ in range(rounds):
        # The pixel of a point before the camera has the point's own direction.
        d = {a: F.col(a) - F.col(f"c{a}") for a in "xyz"}
        far = F.sqrt(d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"])
        rays = seen.withColumns({**{f"d{a}": d[a] / far for a in "xyz"}, **{f"o{a}": F.col(f"c{a}") for a in "xyz"}, "near": bounds[0] * F.col("agl"), "far": bounds[1] * F.col("agl")}).drop("x", "y", "z", "hit", "lidar", "over")
        seen = march(rays, by, terrain, cell, steps)
        seen = seen.withColumns({a: F.col(f"c{a}") + F.col("s") * F.col(f"d{a}") for a in "xyz"})
        seen = heights(seen, terrain, cell).withColumns({"z": F.coalesce("tz", "z"), "lidar": F.coalesce("tl", F.lit(0.0)), "over": F.col("tz").isNotNull()})
        seen = seen.drop("tz", "tl", "s", "near", "far", *(f"{k}{a}" for k in "do" for a in "xyz"))
    return seen


def warp(frames: DataFrame, pixels: DataFrame, terrain: DataFrame, cell: float, camera: Camera, size: int, gsd: float, rounds: int = 3, steps: int = 48, density: float = 0.0, bounds: tuple[float, float] = (0.15, 1.6)) -> DataFrame:
    """Frames laid on the ground: per pixel of each patch (image, r, c, x, y), the frame's value v and confidence.

    A pixel's point starts at the terrain's height; then, ``rounds`` times, the ray to it is
    marched between ``bounds`` times the height above ground and the point moved to where the
    ray meets the terrain.  Confidence is 255 over measured heights, 64 over others, 0 where
    the ray meets nothing or leaves the image; with ``density`` it falls in proportion below
    that many source pixels a patch pixel.  ``lidar`` and ``usable`` tell what it comes from.
    """
    by = ["image", "r", "c"]
    lowest = terrain.agg(F.min(F.col("z").cast("double"))).first()[0]
    # A ray ends at ``bounds[1]`` times the height above ground, so it goes no further sideways.
    reach = F.greatest(bounds[1] * F.greatest(F.lit(LEAST), F.col("cz") - F.lit(lowest)), F.lit(size * gsd)) / cell + 2
    near = F.coalesce(reach <= REACH, F.lit(False)) & F.col("cx").isNotNull() & F.col("cy").isNotNull() & ~F.isnan(F.col("cx") + F.col("cy"))
    found = frames.agg(F.max(F.when(near, reach)), F.count_if(~near)).first()
    halo = int(np.ceil(found[0] or 1))
    seen = _in_parts(frames.filter(near), terrain, cell, size, gsd, rounds, steps, bounds, halo)
    if found[1]:
        seen = seen.unionByName(_by_joins(frames.filter(~near), terrain, cell, size, gsd, rounds, steps, bounds).select(seen.columns))
    at = project(seen, camera)
    inside = (F.col("u") >= 0) & (F.col("u") < camera.width) & (F.col("v") >= 0) & (F.col("v") < camera.height)
    at = at.withColumn("usable", F.coalesce(F.col("hit") & F.col("over") & inside, F.lit(False)))
    if density > 0:
        from .maps import sample_density

        at = sample_density(at).withColumn("share", F.coalesce(F.least(F.col("density") / density, F.lit(1.0)), F.lit(0.0)))
    else:
        at = at.withColumn("share", F.lit(1.0))
    confidence = F.when(F.col("usable"), (255.0 * F.col("lidar") + 64.0 * (1 - F.col("lidar"))) * F.col("share")).otherwise(0.0)
    at = at.select(*by, F.col("x").alias("east"), F.col("y").alias("north"), F.col("u").alias("x"), F.col("v").alias("y"), "lidar", "usable", "agl", confidence.alias("confidence"))
    return grids.bilinear(at, pixels, half_pixel=False).select(*by, "east", "north", F.coalesce("v", F.lit(0.0)).alias("v"), "confidence", "lidar", "usable", "agl")


def mosaic(frames: DataFrame, pixels: DataFrame, terrain: DataFrame, cell: float, camera: Camera, size: int, gsd: float, agl_max: float | None = None, every: int = 1, **options) -> tuple[DataFrame, DataFrame]:
    """Warped frames blended on one grid (r, c, v, weight), and per frame its agl, share over lidar and whether it was skipped.

    Of the frames only those whose number (image) ``every`` divides make a patch.  A frame over
    no terrain, or higher than ``agl_max`` above it, is skipped.
    """
    at = heights(frames.filter(F.col("image") % every == 0), terrain, cell, "cx", "cy").withColumn("above", F.col("cz") - F.col("tz")).drop("tz", "tl")
    skip = F.lit(False) if agl_max is None else F.coalesce(F.col("above") > agl_max, F.lit(True))
    kept, skipped = at.filter(~skip), at.filter(skip)
    laid = warp(kept.drop("above"), pixels, terrain, cell, camera, size, gsd, **options)
    cells = laid.withColumns({"r": F.floor(-F.col("north") / gsd), "c": F.floor(F.col("east") / gsd)})
    stats = laid.groupBy("image").agg(F.first("agl").alias("agl"), F.coalesce(F.avg(F.when(F.col("usable"), F.col("lidar"))), F.lit(0.0)).alias("lidar_share"))
    stats = stats.withColumn("skipped", F.lit(False)).unionByName(skipped.select("image", F.col("above").alias("agl"), F.lit(0.0).alias("lidar_share"), F.lit(True).alias("skipped")))
    return grids.blend(cells.filter("confidence > 0")), stats


def render(frames: DataFrame, scene: DataFrame, terrain: DataFrame, cell: float, camera: Camera, gsd: float, steps: int = 64, bounds: tuple[float, float] = (0.05, 1.6)) -> DataFrame:
    """What a camera sees of a scene: pixels (image, r, c, v); 0 where a ray meets nothing.

    ``scene`` is a raster (r, c, v) of ``gsd`` metres laid on the terrain, r counting north.
    """
    by = ["image", "r", "c"]
    rows, cols = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (camera.height, camera.width))
    px = above_ground(frames, terrain, cell).withColumn("r", rows).withColumn("c", cols)
    px = px.withColumn("__d", imaging.ray(F.col("c") + 0.5, F.col("r") + 0.5, camera.fx, camera.fy, camera.cx, camera.cy, camera.lens))
    world = {f"d{a}": sum((F.col("rot")[3 * i + j] * F.col("__d")[b] for j, b in enumerate("xyz")), F.lit(0.0)) for i, a in enumerate("xyz")}
    rays = px.withColumns({**world, **{f"o{a}": F.col(f"c{a}") for a in "xyz"}, "near": bounds[0] * F.col("agl"), "far": bounds[1] * F.col("agl")}).drop("__d")
    met = march(rays, by, terrain, cell, steps).withColumns({"x": F.col("ox") + F.col("s") * F.col("dx"), "y": F.col("oy") + F.col("s") * F.col("dy")})
    at = met.select(F.col("image").alias("__i"), "r", "c", F.lit(0).alias("image"), F.when(F.col("hit"), F.col("x") / gsd).alias("x"), (F.col("y") / gsd).alias("y"))
    ground = grids.bilinear(at, scene.withColumn("image", F.lit(0)))
    return ground.select(F.col("__i").alias("image"), "r", "c", F.coalesce("v", F.lit(0.0)).alias("v"))


def rectify(frames: DataFrame, pixels: DataFrame, terrain: DataFrame, cell: float, camera: Camera, size: int, gsd: float) -> DataFrame:
    """A frame back on the ground (image, r, c, v) with confidence 1 where it saw it and 0 elsewhere."""
    laid = warp(frames, pixels, terrain, cell, camera, size, gsd, bounds=(0.05, 1.6))
    return laid.select("image", "r", "c", "v", (F.col("confidence") > 0).cast("double").alias("confidence"))


def true_ortho(specs: DataFrame, scene: DataFrame, size: int, gsd: float, gsd_scene: float, samples: int = 2) -> DataFrame:
    """Patches (id, r, c, v) straight from a scene's raster, turned as the pose is, ``samples`` x ``samples`` points a pixel."""
    from .generate import patch_grid

    grid = patch_grid(specs.select("id", "gt_east", "gt_north", "gt_yaw"), size * samples, gsd / samples)
    at = grid.select(F.col("id").alias("__id"), F.col("r").alias("__r"), F.col("c").alias("__c"), F.lit(0).alias("image"), (F.col("east") / gsd_scene).alias("x"), (F.col("north") / gsd_scene).alias("y"))
    got = grids.bilinear(at, scene.withColumn("image", F.lit(0)))
    fine = got.select(F.col("__id").alias("image"), F.col("__r").alias("r"), F.col("__c").alias("c"), F.coalesce("v", F.lit(0.0)).alias("v"))
    return grids.block_mean(fine, samples).withColumnRenamed("image", "id")


def raised(ground: DataFrame, footprints: DataFrame, height: float = 15.0) -> DataFrame:
    """Terrain (r, c, z) with building cells (r, c) ``height`` higher."""
    over = footprints.select("r", "c").distinct().withColumn("__b", F.lit(height))
    return ground.join(over, ["r", "c"], "left").withColumn("z", F.col("z") + F.coalesce("__b", F.lit(0.0))).drop("__b")


def lidar_hits(poses: DataFrame, by: list[str], terrain: DataFrame, cell: float) -> DataFrame:
    """Points (x, y, z) at which a scanner's rays (ox.., dx.., near, far) meet the terrain; rays that meet nothing are left out."""
    met = march(poses, by, terrain, cell, steps=96, halvings=8).filter("hit")
    return met.withColumns({a: F.col(f"o{a}") + F.col("s") * F.col(f"d{a}") for a in "xyz"}).drop("hit", "near", "far")
