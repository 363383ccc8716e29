"""Map windows for requests: which level, whether inside, which rectangle, which tiles; and what a cache of descriptors may keep.

Levels are a table (level, gsd, origin_east, origin_north, width, height), the base first by
gsd; it is small and goes to all tasks.  Positions are in the projected frame of the levels;
``to_projected`` takes local east and north round a geodetic origin there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geodesy
from . import grids


def to_projected(points: DataFrame, origin: tuple[float, float, float], zone: int) -> DataFrame:
    """Add easting and northing of local east and north on the tangent plane of the origin (lat, lon in radians, alt)."""
    df = points.withColumn("__g", geodesy.from_enu(F.col("east"), F.col("north"), F.lit(0.0), origin))
    df = df.withColumn("__u", geodesy.utm(F.col("__g.lat"), F.col("__g.lon"), zone))
    return df.withColumns({"easting": F.col("__u.easting"), "northing": F.col("__u.northing")}).drop("__g", "__u")


def to_local(points: DataFrame, origin: tuple[float, float, float], zone: int) -> DataFrame:
    """The way back, at the origin's height: east and north of easting and northing."""
    df = points.withColumn("__g", geodesy.utm_inverse(F.col("easting"), F.col("northing"), zone))
    df = df.withColumn("__e", geodesy.to_enu(F.col("__g.lat"), F.col("__g.lon"), F.lit(origin[2]), origin))
    return df.withColumns({"east": F.col("__e.east"), "north": F.col("__e.north")}).drop("__g", "__e")


def inside(col: Column, row: Column, width: Column, height: Column) -> Column:
    """Whether a pixel position is on a raster, its far edges included."""
    return (col >= 0) & (col <= width) & (row >= 0) & (row <= height)


def pick_level(requests: DataFrame, levels: DataFrame) -> DataFrame:
    """Add the level of each request (id, east, north, radius_m, gsd): the coarsest that is no coarser than asked, else the base.

    Adds level, level_gsd, origin_east, origin_north, width, height, and base, the base level's.
    """
    parts = ("gsd", "level", "origin_east", "origin_north", "width", "height")
    every = levels.agg(F.min(F.struct(*parts)).alias("base"), F.collect_list(F.struct(*parts)).alias("levels")).withColumn("__one", F.lit(1))
    fit = F.array_max(F.filter("levels", lambda v: v["gsd"] <= F.col("gsd")))
    df = requests.withColumn("__one", F.lit(1)).join(F.broadcast(every), "__one")  # one row, a few levels
    df = df.withColumn("__best", F.coalesce(fit, F.col("base")))
    df = df.withColumns({"level": F.col("__best.level"), "level_gsd": F.col("__best.gsd"), **{c: F.col(f"__best.{c}") for c in parts[2:]}})
    return df.drop("levels", "__best", "__one")


def serve(requests: DataFrame, levels: DataFrame) -> DataFrame:
    """Answer requests (id, east, north, radius_m, gsd): success, message, and the window x0, y0, w, h on its level with its corner's east and north.

    A centre off the base level is refused; the window is clamped to the raster, and refused if nothing is left.
    """
    df = pick_level(requests, levels)
    b = lambda c: F.col(f"base.{c}")
    at_base = ((F.col("east") - b("origin_east")) / b("gsd"), (b("origin_north") - F.col("north")) / b("gsd"))
    ok = inside(*at_base, b("width"), b("height"))
    col, row = (F.col("east") - F.col("origin_east")) / F.col("level_gsd"), (F.col("origin_north") - F.col("north")) / F.col("level_gsd")
    r = F.col("radius_m") / F.col("level_gsd")
    clamp = lambda v, n: F.greatest(F.lit(0), F.least(v, F.col(n))).cast("long")
    side = F.ceil(2 * r)
    df = df.withColumns({"__c": F.floor(col - r), "__r": F.floor(row - r)})
    df = df.withColumns({"x0": clamp(F.col("__c"), "width"), "y0": clamp(F.col("__r"), "height"), "__x1": clamp(F.col("__c") + side, "width"), "__y1": clamp(F.col("__r") + side, "height")})
    df = df.withColumns({"w": F.col("__x1") - F.col("x0"), "h": F.col("__y1") - F.col("y0")})
    message = F.when(~ok, "request centre outside mission package").when((F.col("w") <= 0) | (F.col("h") <= 0), "window outside mission package")
    out = df.withColumns({"message": message, "success": message.isNull()})
    keep = lambda c: F.when(F.col("success"), c)
    corner = {"corner_east": F.col("origin_east") + F.col("x0") * F.col("level_gsd"), "corner_north": F.col("origin_north") - F.col("y0") * F.col("level_gsd")}
    return out.select("id", "success", "message", "level", "level_gsd", *(keep(F.col(c)).alias(c) for c in ("x0", "y0", "w", "h")), *(keep(c).alias(n) for n, c in corner.items()))


def tiles_of(windows: DataFrame, size: int = 256) -> DataFrame:
    """Tiles (level, ty, tx) that each served window (id) touches: what a read or a fetch ahead needs."""
    ok = windows.filter("success")
    rows = ok.withColumn("ty", F.explode(F.sequence(F.floor(F.col("y0") / size), F.floor((F.col("y0") + F.col("h") - 1) / size))))
    return rows.select("id", "level", "ty", F.explode(F.sequence(F.floor(F.col("x0") / size), F.floor((F.col("x0") + F.col("w") - 1) / size))).alias("tx"))


def read(windows: DataFrame, pixels: DataFrame, validity: DataFrame | None = None, size: int = 256) -> DataFrame:
    """Pixels (id, r, c, v, valid) of served windows, r and c from their corners, by an equi-join on tiles.

    ``pixels`` and ``validity`` have level, r, c, v.  Without validity, or where it has no cell, a
    pixel is valid (255).  A window meets each of its tiles once, as arrays, and takes the part
    that is its own.
    """
    cells = pixels.select("level", "r", "c", "v", F.lit(1).alias("here"))
    if validity is not None:
        cells = cells.join(validity.select("level", "r", "c", F.col("v").alias("valid")), ["level", "r", "c"], "left")
    else:
        cells = cells.withColumn("valid", F.lit(255))
    tiles = grids.tiled(cells, ["level"], ["v", "valid", "here"], size).withColumnsRenamed({"tr": "ty", "tc": "tx", "w": "tw", "h": "th"})
    at = tiles_of(windows, size).join(windows.select("id", F.col("x0").alias("wx"), F.col("y0").alias("wy"), F.col("w").alias("ww"), F.col("h").alias("wh")), "id")
    met = at.join(tiles, ["level", "ty", "tx"]).withColumnsRenamed({"tw": "w", "th": "h"})
    rows = F.sequence(F.greatest("wy", "r0"), F.least(F.col("wy") + F.col("wh"), F.col("r0") + F.col("h")) - 1)
    cols = F.sequence(F.greatest("wx", "c0"), F.least(F.col("wx") + F.col("ww"), F.col("c0") + F.col("w")) - 1)
    met = met.filter("greatest(wy, r0) < least(wy + wh, r0 + h) AND greatest(wx, c0) < least(wx + ww, c0 + w)").withColumn("__r", F.explode(rows)).withColumn("__c", F.explode(cols))
    pick = lambda v: grids.in_tile(v, F.col("__r"), F.col("__c"))
    met = met.select("id", (F.col("__r") - F.col("wy")).alias("r"), (F.col("__c") - F.col("wx")).alias("c"), pick("v").alias("v"), F.coalesce(pick("valid"), F.lit(255)).alias("valid"), pick("here").alias("here"))
    return met.filter("here IS NOT NULL").drop("here")


def requests_for(patches: DataFrame, windows: DataFrame, deadline_s: float = 0.2) -> DataFrame:
    """The window (id, t_s) that answers each patch (id, t_s): the first at or after it, if within the deadline; late is whether none was.

    An as-of join: both in one order by id and time, latest first, answers before the patches of their time.
    """
    both = patches.select("id", "t_s", F.lit(0).alias("__kind")).unionByName(windows.select("id", "t_s", F.lit(1).alias("__kind")))
    back = W.partitionBy("id").orderBy(F.desc("t_s"), F.desc("__kind")).rowsBetween(W.unboundedPreceding, W.currentRow)
    met = both.withColumn("answered", F.last(F.when(F.col("__kind") == 1, F.col("t_s")), ignorenulls=True).over(back)).filter("__kind = 0")
    late = F.col("answered").isNull() | (F.col("answered") - F.col("t_s") > deadline_s)
    return met.select("id", F.col("t_s").alias("asked"), F.when(~late, F.col("answered")).alias("answered"), late.alias("late"))


def descriptors_valid(east: Column, north: Column, radius_m: Column, gsd: Column, model: Column, held: Column, share: float = 0.3, by_model: bool = True) -> Column:
    """Whether descriptors kept for ``held`` (east, north, gsd, model) serve a request: moved by at most ``share`` of its window, same gsd, same model."""
    moved = F.hypot(east - held["east"], north - held["north"])
    same = (gsd == held["gsd"]) & ((model == held["model"]) if by_model else F.lit(True))
    return F.coalesce((moved <= share * 2 * radius_m) & same, F.lit(False))


def bounds_of(corners: DataFrame, zone: int) -> DataFrame:
    """Projected bounds of geographic corners (west, south, east, north in degrees), a row each: east_min, east_max, north_min, north_max."""
    ends = F.array(*(F.struct(F.radians(lat).alias("lat"), F.radians(lon).alias("lon")) for lat in ("south", "north") for lon in ("west", "east")))
    rows = corners.withColumn("__id", F.struct(*corners.columns)).withColumn("__p", F.explode(ends))
    rows = rows.withColumn("__u", geodesy.utm(F.col("__p.lat"), F.col("__p.lon"), zone))
    return rows.groupBy("__id").agg(*(f(F.col(f"__u.{c}ing")).alias(f"{c}_{n}") for c in ("east", "north") for n, f in (("min", F.min), ("max", F.max)))).select("__id.*", "east_min", "east_max", "north_min", "north_max")


def tile_cover(boxes: DataFrame, z: int) -> DataFrame:
    """Map tiles (x, y) that each box (west, south, east, north in degrees) touches."""
    a, b = geodesy.tile_of(F.col("west"), F.col("north"), F.lit(z)), geodesy.tile_of(F.col("east"), F.col("south"), F.lit(z))
    rows = boxes.withColumn("x", F.explode(F.sequence(a["x"], b["x"]))).withColumns({"__a": a, "__b": b})
    return rows.withColumn("y", F.explode(F.sequence(F.col("__a.y"), F.col("__b.y")))).drop("__a", "__b")


def levels_of(base: DataFrame, factors: tuple[int, ...] = (1, 2, 4, 8)) -> DataFrame:
    """Levels of a pyramid over a base raster (gsd, origin_east, origin_north, width, height), sizes rounded up."""
    k = F.explode(F.array(*map(F.lit, factors))).alias("k")
    up = lambda c: F.ceil(F.col(c) / F.col("k")).cast("long").alias(c)
    rows = base.select("*", k).select("k", (F.col("gsd") * F.col("k")).alias("gsd"), "origin_east", "origin_north", up("width"), up("height"))
    return rows.withColumn("level", F.row_number().over(W.partitionBy("origin_east", "origin_north").orderBy("gsd")) - 1).drop("k")
