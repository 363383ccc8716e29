"""Pixel tables (image, r, c, value): gridding, sampling, focal windows, masks, rasterising.

Neighbourhoods are equi-joins on shifted cells, so that work is split by cell and no image
has to fit anywhere whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quantiles import exact_quantiles, same_keys


def accumulate(points: DataFrame, keys: tuple[str, ...] = ("r", "c"), range_max: float | None = None) -> DataFrame:
    """Per cell: z_max, n, z2 (sum of squares), mean, true spread, and spread about the maximum (kept for comparison).

    With ``range_max`` only points up to that range (range_m) count.
    """
    points = points if range_max is None else points.filter(F.col("range_m") <= range_max)
    cell = points.groupBy(*keys).agg(F.max("z").alias("z_max"), F.count("*").alias("n"), F.sum(F.col("z") * F.col("z")).alias("z2"), F.avg("z").alias("z_mean"), F.stddev_pop("z").alias("spread"))
    about_max = F.sqrt(F.greatest(F.lit(0.0), F.col("z2") / F.col("n") - F.col("z_max") * F.col("z_max")))
    return cell.withColumn("spread_about_max", about_max)


def texture_spread(pixels: DataFrame, value: str = "v") -> DataFrame:
    """Population standard deviation of each image's values."""
    return pixels.groupBy("image").agg(F.stddev_pop(F.col(value).cast("double")).alias("spread"))


def mean_merge(heights: DataFrame) -> DataFrame:
    """Per cell, the mean of what covers it and how many do."""
    return heights.groupBy("r", "c").agg(F.avg("z").alias("z"), F.count("z").alias("n"))


def blend(patches: DataFrame, value: str = "v", confidence: str = "confidence") -> DataFrame:
    """Mosaic of overlapping patches: values weighted by the square of their confidence; null where none has any."""
    w = F.col(confidence) * F.col(confidence)
    return patches.groupBy("r", "c").agg(F.try_divide(F.sum(F.col(value) * w), F.sum(w)).alias(value), F.sum(w).alias("weight"))


def masked_ratio(cells: DataFrame, by: list[str], hit: Column, mask: Column) -> DataFrame:
    """Share of the cells in the mask that are hit; 0 for an empty mask."""
    return cells.groupBy(*by).agg(F.coalesce(F.avg(F.when(mask, hit.cast("double"))), F.lit(0.0)).alias("ratio"))


def fallback(measured: DataFrame, other: DataFrame) -> DataFrame:
    """Heights (r, c, z) of ``measured`` where there is one, else of ``other``; ``measured`` tells which."""
    a, b = measured.select("r", "c", F.col("z").alias("__a")), other.select("r", "c", F.col("z").cast("double").alias("__b"))
    return b.join(a, ["r", "c"], "full").select("r", "c", F.coalesce("__a", "__b").alias("z"), F.col("__a").isNotNull().alias("measured"))


def vertical_offset(surface: DataFrame, ground: DataFrame, dense: int = 4, least: tuple[int, int] = (100, 50)) -> DataFrame:
    """shift_m to add to a surface (r, c, z, n) so that its ground meets another one's (r, c, z); one row.

    The surface's ground is the median of its dense cells between their 5th and 20th
    percentile; 0 with fewer than ``least`` dense cells, or of them with a height to meet.
    """
    cells = surface.filter(F.col("n") >= dense).select("r", "c", "z")
    ends = exact_quantiles(cells, [], {"lo": (F.col("z"), 0.05), "hi": (F.col("z"), 0.2)})
    low = same_keys(cells, ends, []).filter("z BETWEEN lo AND hi")
    mine = exact_quantiles(low, [], {"mine": (F.col("z"), 0.5)})
    there = cells.select("r", "c").join(ground.select("r", "c", F.col("z").cast("double").alias("g")), ["r", "c"]).filter("g IS NOT NULL AND NOT isnan(g)")
    theirs = exact_quantiles(there, [], {"theirs": (F.col("g"), 0.5)})
    sizes = same_keys(cells.agg(F.count("*").alias("dense")), there.agg(F.count("*").alias("met")), [])
    all_ = same_keys(same_keys(sizes, mine, [], "left"), theirs, [], "left")
    return all_.select(F.when((F.col("dense") >= least[0]) & (F.col("met") >= least[1]), F.col("theirs") - F.col("mine")).otherwise(0.0).alias("shift_m"))


def peak(surface: DataFrame, separation: int, height: int, width: int) -> DataFrame:
    """Of each correlation surface (image, r, c, v), which wraps round: pr, pc, peak, second, ratio, fwhm.

    ``second`` is the greatest value further than ``separation`` rows or columns from the peak;
    ``fwhm`` the mean distance, to the right and down, at which the surface falls to half way
    between the peak and the upper median, linear between cells, 15 if it does not within 15.
    """
    top = surface.groupBy("image").agg(F.max(F.struct(F.col("v").alias("v"), (-F.col("r")).alias("nr"), (-F.col("c")).alias("nc"))).alias("m"))
    top = top.select("image", (-F.col("m.nr")).alias("pr"), (-F.col("m.nc")).alias("pc"), F.col("m.v").alias("peak"))
    rows = surface.join(top, "image")
    wrap = lambda a, b, n: F.least(F.abs(a - b), n - F.abs(a - b))
    apart = (wrap(F.col("c"), F.col("pc"), width) > separation) | (wrap(F.col("r"), F.col("pr"), height) > separation)
    along = F.when(F.col("r") == F.col("pr"), F.pmod(F.col("c") - F.col("pc"), F.lit(width)))
    down = F.when(F.col("c") == F.col("pc"), F.pmod(F.col("r") - F.col("pr"), F.lit(height)))
    near = lambda d: F.array_sort(F.collect_list(F.when(d.between(0, 15), F.struct(d.cast("int").alias("d"), F.col("v").alias("v")))))
    got = rows.groupBy("image", "pr", "pc", "peak").agg(
        F.max(F.when(apart, F.col("v"))).alias("second"), near(along).alias("__x"), near(down).alias("__y"), F.array_sort(F.collect_list("v")).alias("__v"),
    )
    half = (F.col("peak") + F.get("__v", F.floor(F.size("__v") / 2).cast("int"))) / 2

    def width_along(line: str) -> Column:
        first = F.array_min(F.transform(F.filter(line, lambda p: (p["d"] > 0) & (p["v"] <= half)), lambda p: p["d"]))
        value = lambda d: F.get(F.transform(F.filter(line, lambda p: p["d"] == d), lambda p: p["v"]), F.lit(0))
        at, before = value(first), value(first - 1)
        return F.when(first.isNull(), 15.0).when(first == 1, 0.5).otherwise(first - 1 + (half - before) / (at - before + 1e-12))

    ratio = F.when(F.col("second") > 1e-12, F.col("peak") / F.col("second")).otherwise(1e9)
    return got.select("image", "pr", "pc", "peak", "second", ratio.alias("ratio"), ((width_along("__x") + width_along("__y")) / 2).alias("fwhm"))


def stretch(pixels: DataFrame, low: float = 0.02, high: float = 0.98, value: str = "v") -> DataFrame:
    """The values of each image between which a preview spreads its greys (image, lo, hi)."""
    return exact_quantiles(pixels, ["image"], {"lo": (F.col(value).cast("double"), low), "hi": (F.col(value).cast("double"), high)})


def seams(tiles: DataFrame, source: str) -> DataFrame:
    """Adjacent tiles (x, y, x2, y2) that are of different sources; a null source is of none."""
    of = tiles.filter(F.col(source).isNotNull()).select("x", "y", F.col(source).alias("__of"))
    there = of.withColumnsRenamed({"x": "x2", "y": "y2", "__of": "__of2"})
    return adjacent_tiles(of).join(of, ["x", "y"]).join(there, ["x2", "y2"]).filter("__of <> __of2").select("x", "y", "x2", "y2")


def placeholder_tiles(tiles: DataFrame, least: int = 4, spread: float = 8.0) -> DataFrame:
    """Those of ``tiles`` (digest, spread) whose content repeats ``least`` times or more and has hardly any texture."""
    flat = tiles.groupBy("digest").agg(F.count("*").alias("__n"), F.min("spread").alias("__s")).filter((F.col("__n") >= least) & (F.col("__s") < spread))
    return tiles.join(flat.select("digest"), "digest", "left_semi")


def neighbours(cells: DataFrame, reach: int, value: str, keys: tuple[str, ...] = ("r", "c"), cross: bool = False) -> DataFrame:
    """(keys, near): each cell's values within ``reach``, itself included; ``cross`` leaves out diagonals."""
    r, c = keys[-2:]
    d = F.sequence(F.lit(-reach), F.lit(reach))
    sent = cells.select(*keys, F.col(value).alias("near")).withColumn("dr", F.explode(d)).withColumn("dc", F.explode(d))
    sent = sent.filter("abs(dr) + abs(dc) <= 1") if cross else sent
    return sent.select(*keys[:-2], (F.col(r) + F.col("dr")).alias(r), (F.col(c) + F.col("dc")).alias(c), "near")


def focal_median(cells: DataFrame, reach: int = 2, outlier: float = 3.0, dense: int = 4, loose: float = 2.0) -> DataFrame:
    """Replace heights that differ from the median around them, and grade confidence.

    255 dense, 192 dense but dispersed, 128 sparse, 96 replaced.  Cells without points do not
    take part.
    """
    around = neighbours(cells, reach, "z_max").groupBy("r", "c").agg(F.median("near").alias("med"))
    df = cells.join(around, ["r", "c"])
    out = F.abs(F.col("z_max") - F.col("med")) > outlier
    conf = F.when(out, 96).when((F.col("n") >= dense) & (F.col("spread_about_max") > loose), 192).when(F.col("n") >= dense, 255).otherwise(128)
    return df.withColumns({"z": F.when(out, F.col("med")).otherwise(F.col("z_max")), "confidence": conf})


def gradient(pixels: DataFrame, value: str = "v") -> DataFrame:
    """Central differences gx, gy within an image; a border pixel uses itself for the missing side."""
    row, col = W.partitionBy("image", "r").orderBy("c"), W.partitionBy("image", "c").orderBy("r")
    half = lambda w: (F.coalesce(F.lead(value).over(w), F.col(value)) - F.coalesce(F.lag(value).over(w), F.col(value))) / 2
    return pixels.withColumns({"gx": half(row), "gy": half(col)})


def sobel(pixels: DataFrame, value: str = "v") -> DataFrame:
    """Sobel gx, gy with replicated edges: a smoothing pass and a difference pass by windows."""
    row, col = W.partitionBy("image", "r").orderBy("c"), W.partitionBy("image", "c").orderBy("r")
    lo, hi = (lambda x, w: F.coalesce(F.lag(x).over(w), F.col(x))), (lambda x, w: F.coalesce(F.lead(x).over(w), F.col(x)))
    df = pixels.withColumns({"__sr": lo(value, row) + 2 * F.col(value) + hi(value, row), "__sc": lo(value, col) + 2 * F.col(value) + hi(value, col)})
    return df.withColumns({"gx": hi("__sc", row) - lo("__sc", row), "gy": hi("__sr", col) - lo("__sr", col)}).drop("__sr", "__sc")


def box_blur(pixels: DataFrame, passes: int = 1, value: str = "v") -> DataFrame:
    """Separable three-tap mean with replicated edges."""
    row, col = W.partitionBy("image", "r").orderBy("c"), W.partitionBy("image", "c").orderBy("r")
    df = pixels
    for _ in range(passes):
        for w in (row, col):
            df = df.withColumn(value, (F.coalesce(F.lag(value).over(w), F.col(value)) + F.col(value) + F.coalesce(F.lead(value).over(w), F.col(value))) / 3)
    return df


def dilate(mask: DataFrame, steps: int = 1) -> DataFrame:
    """Cells set in ``mask`` (image, r, c) and those within ``steps`` of them, sideways and up or down."""
    d = F.sequence(F.lit(-steps), F.lit(steps))
    sent = mask.withColumn("dr", F.explode(d)).withColumn("dc", F.explode(d)).filter(F.abs("dr") + F.abs("dc") <= steps)
    return sent.select("image", (F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c")).distinct()


def block_mean(pixels: DataFrame, factor: int, value: str = "v") -> DataFrame:
    """An overview: the mean of blocks of ``factor`` x ``factor``."""
    return pixels.groupBy("image", F.floor(F.col("r") / factor).alias("r"), F.floor(F.col("c") / factor).alias("c")).agg(F.avg(value).alias(value))


#: Cells along a tile's side.
TILE = 32


def tiled(cells: DataFrame, keys: list[str], values: list[str], size: int = TILE, halo: int = 0) -> DataFrame:
    """Cells (keys, r, c, values) as rows of ``size`` x ``size``: keys, tr, tc, r0, c0, w, h and an array a value.

    An array has the tile's smallest rectangle of cells, row by row, null where there is none;
    with ``halo`` a tile also has so many rows and columns of those below and right of it.
    A cell is there once.
    """
    at = lambda c: F.sequence(F.floor((F.col(c) - halo) / size), F.floor(F.col(c) / size)) if halo else F.array(F.floor(F.col(c) / size))
    rows = cells.select(*keys, "r", "c", F.struct(*values).alias("__v"), F.explode(at("r")).alias("tr")).withColumn("tc", F.explode(at("c")))
    made = rows.groupBy(*keys, "tr", "tc").agg(F.min("r").alias("r0"), F.max("r").alias("__r1"), F.min("c").alias("c0"), F.max("c").alias("__c1"), F.collect_list(F.struct("r", "c", "__v")).alias("__cells"))
    made = made.withColumns({"w": (F.col("__c1") - F.col("c0") + 1).cast("int"), "h": (F.col("__r1") - F.col("r0") + 1).cast("int")})
    place = lambda x: ((x["r"] - F.col("r0")) * F.col("w") + x["c"] - F.col("c0")).cast("int")
    own = F.transform("__cells", lambda x: F.struct(place(x).alias("at"), F.lit(1).alias("some"), x["__v"].alias("v")))
    none = F.transform(F.sequence(F.lit(0), F.col("w") * F.col("h") - 1), lambda i: F.struct(i.alias("at"), F.lit(0).alias("some"), F.lit(None).cast(made.schema["__cells"].dataType.elementType["__v"].dataType).alias("v")))
    made = made.withColumn("__all", F.sort_array(F.when(F.size("__cells") == F.col("w") * F.col("h"), own).otherwise(F.concat(own, none))))
    # Of a place's two entries the one with a value comes second.
    last = F.filter("__all", lambda x, i: (x["some"] == 1) | (F.get("__all", i + 1)["at"].isNull()) | (F.get("__all", i + 1)["at"] != x["at"]))
    def only(v: str) -> Column:
        return F.transform("__kept", lambda x: x["v"][v]).alias(v)

    return made.withColumn("__kept", last).select(*keys, "tr", "tc", "r0", "c0", "w", "h", *map(only, values))


def in_tile(array: str | Column, r: Column, c: Column, prefix: str = "") -> Column:
    """The value at (r, c) of a tile's array; null outside it."""
    at = {k: F.col(prefix + k) for k in ("r0", "c0", "w", "h")}
    y, x = r - at["r0"], c - at["c0"]
    return F.when((y >= 0) & (x >= 0) & (y < at["h"]) & (x < at["w"]), F.get(array, (y * at["w"] + x).cast("int")))


def bilinear(points: DataFrame, pixels: DataFrame, half_pixel: bool = True, value: str = "v") -> DataFrame:
    """``points`` (image, x, y and others) with the value at each, each row for itself.

    A point meets one tile of pixels, which has a row and a column of its neighbours too, so
    nothing is exploded and equal points stay as many as they are.  Null unless all of the four
    cells that carry weight are there and not null, and for points without x or y.  ``half_pixel``: the first cell's centre is
    at 0.5; otherwise its corner is at 0.
    """
    s = 0.5 if half_pixel else 0.0
    keep = [c for c in points.columns if c != value]
    df = points.select(*keep).withColumns({"__u": F.col("x") - s, "__w": F.col("y") - s}).withColumns({"__pc": F.floor("__u"), "__pr": F.floor("__w")})
    df = df.withColumns({"__tr": F.floor(F.col("__pr") / TILE), "__tc": F.floor(F.col("__pc") / TILE)})
    tiles = tiled(pixels.select("image", "r", "c", F.col(value).alias("__value")), ["image"], ["__value"], halo=1).withColumnsRenamed({"image": "__image", "tr": "__tr2", "tc": "__tc2", **{k: f"__t_{k}" for k in ("r0", "c0", "w", "h")}})
    got = df.join(tiles, (F.col("image") == F.col("__image")) & (F.col("__tr") == F.col("__tr2")) & (F.col("__tc") == F.col("__tc2")), "left")
    fx, fy, terms = F.col("__u") - F.col("__pc"), F.col("__w") - F.col("__pr"), []
    for dr in (0, 1):
        for dc in (0, 1):
            weight = (fx if dc else 1 - fx) * (fy if dr else 1 - fy)
            terms.append(F.when(weight > 0, weight * in_tile("__value", F.col("__pr") + dr, F.col("__pc") + dc, "__t_").cast("double")).when(weight == 0, 0.0))
    return got.select(*keep, (terms[0] + terms[1] + terms[2] + terms[3]).alias(value))


def _side(reach: int) -> int:
    """Cells along the sides of the squares by which sums over windows are made: one with what is around it is all that a task holds."""
    return max(128, 4 * reach)


def _with_halo(cells: DataFrame, side: int, halo: int) -> DataFrame:
    """Cells (r, c and others) with the squares tr, tc that they are in or ``halo`` cells from: more than one near a border."""
    squares = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / side), F.floor((F.col(c) + halo) / side)))
    return cells.withColumn("tr", squares("r")).withColumn("tc", squares("c"))


def _box_sums(field: np.ndarray, y: np.ndarray, x: np.ndarray, reach: int) -> np.ndarray:
    """Sums of ``field`` in the squares round (y + reach, x + reach), by four look-ups of its summed-area table."""
    table = np.pad(field.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
    b, r = y + 2 * reach + 1, x + 2 * reach + 1
    return table[b, r] - table[y, r] - table[b, x] + table[y, x]


def window_sums(points: DataFrame, cells: DataFrame, reach: int, values: dict[str, Column]) -> DataFrame:
    """Sums of whole-number ``values`` in the square of ``reach`` cells around each point (id, r, c), by four look-ups whatever the reach.

    Points meet the cells of their part of the raster, which has a summed-area table of its own.
    Points of one id count together; those whose square has no cell are left out.
    """
    side, names = _side(reach), list(values)
    own = {f"t{a}": F.floor(F.col(a) / side) for a in "rc"}
    # Columns of its own: a cogroup confuses those that both sides have from one table.
    asked = points.select(F.col("id").alias("id"), F.col("r").alias("r"), F.col("c").alias("c")).dropna(subset=["r", "c"]).withColumns(own)
    sent = _with_halo(cells.select("r", "c", *(F.coalesce(e.cast("long"), F.lit(0)).alias(v) for v, e in values.items())), side, reach)
    schema = f"id {dict(asked.dtypes)['id']}, {', '.join(f'{v} long' for v in names)}"

    def kernel(key: tuple[int, int], at: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        if not len(at) or not len(near):
            return pd.DataFrame(columns=["id", *names])
        top, left = (k * side - reach for k in key)
        place = near["r"].to_numpy() - top, near["c"].to_numpy() - left
        y, x = at["r"].to_numpy() - top - reach, at["c"].to_numpy() - left - reach
        made = {}
        for v in ["", *names]:
            field = np.zeros((side + 2 * reach,) * 2, np.int64)
            np.add.at(field, place, near[v].to_numpy() if v else 1)
            made[v] = _box_sums(field, y, x, reach)
        some = made.pop("") > 0
        return pd.DataFrame({"id": at["id"], **made})[some]

    got = asked.groupBy("tr", "tc").cogroup(sent.groupBy("tr", "tc")).applyInPandas(kernel, schema)
    return got.groupBy("id").agg(*(F.sum(v).alias(v) for v in names))


def window_fractions(points: DataFrame, classes: DataFrame, reach: int, n_classes: int = 6) -> DataFrame:
    """Shares of each class in the square of ``reach`` cells around each point (id, r, c), and n, the cells there; points without any are left out."""
    counts = {"n": F.lit(1), **{f"f{i}": F.when(F.col("class") == i, 1).otherwise(0) for i in range(n_classes)}}
    sums = window_sums(points, classes, reach, counts).filter("n > 0")
    return sums.select("id", "n", *((F.col(f"f{i}") / F.col("n")).alias(f"f{i}") for i in range(n_classes)))


def _correlations(a: DataFrame, b: DataFrame, reach: int, step: int, least: float, shifts: int) -> DataFrame:
    """(r, c, dr, dc, n, ncc) of each square and shift of ``b``; both rasters' cells of a part of the plane meet in one group, a cell is there once."""
    side = _side(reach + shifts)
    both = [_with_halo(x.filter("v IS NOT NULL").select("r", "c", F.col("v").cast("long").alias("v"), F.lit(i).alias("side")), side, reach + i * shifts) for i, x in enumerate((a, b))]
    names = ["n", "sx", "sy", "xx", "yy", "xy"]
    width = side + 2 * reach

    def kernel(key: tuple[int, int], pdf: pd.DataFrame) -> pd.DataFrame:
        fields = []
        for i, halo in enumerate((reach, reach + shifts)):
            own = pdf[pdf["side"] == i]
            field, there = np.zeros((side + 2 * halo,) * 2, np.int64), np.zeros((side + 2 * halo,) * 2, bool)
            place = tuple(own[axis].to_numpy() - (k * side - halo) for axis, k in zip("rc", key, strict=True))
            field[place], there[place] = own["v"].to_numpy(), True
            fields.append((field, there))
        (x, has), (other, there) = fields
        ys, xs = (np.flatnonzero((k * side + np.arange(side)) % step == 0) for k in key)
        made = []
        for dr in range(-shifts, shifts + 1):
            for dc in range(-shifts, shifts + 1):
                part = slice(shifts - dr, shifts - dr + width), slice(shifts - dc, shifts - dc + width)
                met, y = has & there[part], other[part]
                at = np.argwhere(met[np.ix_(ys + reach, xs + reach)])
                at_y, at_x = ys[at[:, 0]], xs[at[:, 1]]
                moments = (met, x * met, y * met, x * x * met, y * y * met, x * y * met)
                sums = {n: _box_sums(m.astype(np.int64), at_y, at_x, reach) for n, m in zip(names, moments, strict=True)}
                made.append(pd.DataFrame({"r": at_y + key[0] * side, "c": at_x + key[1] * side, "dr": dr, "dc": dc, **sums}))
        return pd.concat(made)

    m = both[0].unionByName(both[1]).groupBy("tr", "tc").applyInPandas(kernel, "r long, c long, dr int, dc int, " + ", ".join(f"{n} long" for n in names))
    n = F.col("n")
    spread = F.sqrt((n * F.col("xx") - F.col("sx") * F.col("sx")).cast("double")) * F.sqrt((n * F.col("yy") - F.col("sy") * F.col("sy")).cast("double"))
    ncc = F.when(n >= least * (2 * reach + 1) ** 2, F.try_divide((n * F.col("xy") - F.col("sx") * F.col("sy")).cast("double"), spread))
    return m.select("r", "c", "dr", "dc", "n", ncc.alias("ncc"))


def windowed_correlation(a: DataFrame, b: DataFrame, reach: int, step: int, least: float = 0.6) -> DataFrame:
    """Normalised correlation of two rasters of whole numbers (r, c, v) in squares of ``reach`` cells, centres ``step`` apart (r, c, n, ncc).

    Moments come from summed-area tables over the cells that both have.  Squares with less
    than ``least`` of their cells, or without spread, have null.
    """
    return _correlations(a, b, reach, step, least, 0).drop("dr", "dc")


def windowed_offset(a: DataFrame, b: DataFrame, reach: int, step: int, shifts: int) -> DataFrame:
    """Per square (r, c) the shift of ``b`` (dr, dc up to ``shifts`` cells) with the greatest correlation; ties go to the least shift.

    All shifts of a part of the plane are made where its cells are; squares compare theirs by a maximum.
    """
    best = F.max(F.struct("ncc", (-F.abs("dr") - F.abs("dc")).alias("near"), "dr", "dc")).alias("m")
    return _correlations(a, b, reach, step, 0.6, shifts).filter("ncc IS NOT NULL").groupBy("r", "c").agg(best).select("r", "c", "m.dr", "m.dc", "m.ncc")


#: A row of cells and a column as one whole number, in the order of both: row times this plus column.
SPAN = 1 << 32


def row_of(key: Column) -> Column:
    return F.shiftright(key + SPAN // 2, 32)


def _crossings(edges: DataFrame) -> DataFrame:
    """Per ring (ring, keys) where its edges cross the middles of rows of cells, in order: row times ``SPAN`` plus x, the first cell whose centre is not left of it.

    A ring's crossings are an array of its row, so that none of them is shuffled or sorted
    among those of others.  Of a row of an open line the last one without a partner is left out.
    """
    rings = edges.filter("y1 <> y2 AND x1 IS NOT NULL AND x2 IS NOT NULL").groupBy("ring").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("e"))
    keys = f"""flatten(transform(e, e -> transform(
        filter(sequence(ceil(least(e.y1, e.y2) - 0.5D), ceil(greatest(e.y1, e.y2) - 0.5D)), r -> r + 0.5D >= least(e.y1, e.y2) AND r + 0.5D < greatest(e.y1, e.y2)),
        r -> r * {SPAN} + ceil(e.x1 + (r + 0.5D - e.y1) / (e.y2 - e.y1) * (e.x2 - e.x1) - 0.5D))))"""
    # Arrays that lambdas use come out of an explode, so that they are made once and not in each lambda.
    rows = rings.select("ring", F.explode(F.array(F.sort_array(F.expr(keys)))).alias("keys"))
    paired = F.forall(_pairs(F.col("keys")), lambda p: row_of(p["a"]) == row_of(p["b"])) & (F.size("keys") % 2 == 0)
    last = lambda k, i: row_of(k) != F.coalesce(row_of(F.get("keys", i + 1)), row_of(k) + 1)
    odd = lambda k: F.size(F.filter("keys", lambda q: row_of(q) == row_of(k))) % 2 == 1
    return rows.select("ring", F.explode(F.array(F.when(paired, F.col("keys")).otherwise(F.filter("keys", lambda k, i: ~(last(k, i) & odd(k)))))).alias("keys"))


def _pairs(keys: Column) -> Column:
    """Every first and second of an array (a, b)."""
    at = F.when(F.size(keys) > 1, F.sequence(F.lit(0), F.floor(F.size(keys) / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(F.get(keys, 2 * i).alias("a"), F.get(keys, 2 * i + 1).alias("b")))


def polygon_runs(edges: DataFrame) -> DataFrame:
    """Runs of cells (ring, r, c0, c1; c1 is past the end) whose centre is inside a ring, even-odd; ``edges`` (ring, x1, y1, x2, y2).

    The crossings of a ring with a row of cells, in order, bound the runs that are inside, so
    work is edges times the rows that they span and not rings times cells.  Rows and columns
    are within 31 bits.
    """
    runs = _crossings(edges).select("ring", F.explode(_pairs(F.col("keys"))).alias("p")).filter("p.a < p.b").withColumn("r", row_of(F.col("p.a")))
    return runs.select("ring", "r", (F.col("p.a") - F.col("r") * SPAN).alias("c0"), (F.col("p.b") - F.col("r") * SPAN).alias("c1"))


def polygon_mask(edges: DataFrame, height: int | None = None, width: int | None = None) -> DataFrame:
    """Cells (ring, r, c) whose centre is inside a ring, even-odd; of a raster of ``height`` x ``width`` if given."""
    runs = polygon_runs(edges)
    if height is not None and width is not None:
        runs = runs.filter(F.col("r").between(0, height - 1)).withColumns({"c0": F.greatest("c0", F.lit(0)), "c1": F.least("c1", F.lit(width))}).filter("c0 < c1")
    return runs.select("ring", "r", F.explode(F.sequence(F.col("c0"), F.col("c1") - 1)).alias("c"))


def polygon_cells(edges: DataFrame) -> DataFrame:
    """How many cells have their centre inside each ring (ring, cells)."""
    length = F.aggregate(_pairs(F.col("keys")), F.lit(0).cast("long"), lambda n, p: n + p["b"] - p["a"])
    return _crossings(edges).filter("size(keys) > 1").select("ring", length.alias("cells")).groupBy("ring").agg(F.sum("cells").alias("cells")).filter("cells > 0")


def area_cells(edges: DataFrame) -> DataFrame:
    """Cells (area, r, c) inside an odd number of an area's rings: inner rings are holes; ``edges`` (area, ring, x1, y1, x2, y2).

    The crossings of all rings of an area with a row of cells bound its runs together, so rings
    are never compared with each other.
    """
    runs = polygon_runs(edges.select(F.col("area").alias("ring"), "x1", "y1", "x2", "y2"))
    return runs.select(F.col("ring").alias("area"), "r", F.explode(F.sequence(F.col("c0"), F.col("c1") - 1)).alias("c"))


def clear_polygons(mask: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A raster (r, c, v) with 0 inside any ring, and per ring how many of its cells were not 0 before (ring, cleared).

    Rings are cleared one after the other, by number: a cell counts for the first that covers it.
    """
    inside = polygon_mask(edges).groupBy("r", "c").agg(F.min("ring").alias("ring"))
    out = mask.join(inside, ["r", "c"], "left")
    cleared = out.filter("ring IS NOT NULL AND v <> 0").groupBy("ring").agg(F.count("*").alias("cleared"))
    return out.select("r", "c", F.when(F.col("ring").isNull(), F.col("v")).otherwise(F.lit(0)).alias("v")), cleared


#: Rows of cells that segments cross, at a time in a task of ``thick_runs``.
STRIPES = 500_000


def thick_runs(segments: DataFrame, half: float) -> DataFrame:
    """Runs of cells (r, c0, c1; c1 is past the end) whose centre is within ``half`` cells of a line's segments (line, x1, y1, x2, y2), with its class if it has one.

    A line's runs are disjoint.  A line is one row with its segments, and a segment has one run
    a row of cells, so that no cell is shuffled or compared with another.
    """
    by = [c for c in segments.columns if c not in ("x1", "y1", "x2", "y2")]
    ends = [F.col(f"s.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")]
    lines = segments.dropna(subset=["x1", "y1", "x2", "y2"]).groupBy(*by).agg(F.collect_list(F.struct(*(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")))).alias("s")).select(F.struct(*by).alias("line"), *ends)
    schema = f"line {dict(lines.dtypes)['line']}, r long, c0 long, c1 long"

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("line")
            x1, y1, x2, y2 = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("x1", "y1", "x2", "y2"))
            of = np.repeat(np.arange(len(names)), batch.column("x1").value_lengths().to_numpy(zero_copy_only=False))
            work = np.cumsum(np.abs(y2 - y1) + 2 * half + 3)
            # Parts of about ``STRIPES`` rows of cells that end with a line.
            starts = np.flatnonzero(np.diff(of, prepend=-1))
            part = np.floor((work[starts] - work[0]) / STRIPES)
            for lo, hi in zip(b := starts[np.flatnonzero(np.diff(part, prepend=-1))], [*b[1:], len(of)], strict=True):
                line, r, c0, c1 = merged(*stripes(of[lo:hi], x1[lo:hi], y1[lo:hi], x2[lo:hi], y2[lo:hi], half))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(line)), pa.array(r), pa.array(c0), pa.array(c1)], ["line", "r", "c0", "c1"])

    return lines.mapInArrow(kernel, schema).select("line.*", "r", "c0", "c1")


def stripes(of: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, half: float) -> tuple[np.ndarray, ...]:
    """(of, r, c0, c1): the run of cells of each row within ``half`` of each segment.

    Where the row meets the discs about the ends and the rectangle between them bounds the run;
    the cells at its ends are held against the distance itself.
    """
    low = np.ceil(np.minimum(y1, y2) - half - 1e-6).astype(np.int64)
    n = np.floor(np.maximum(y1, y2) + half + 1e-6).astype(np.int64) - low + 1
    of, x1, y1, x2, y2 = (np.repeat(v, n) for v in (of, x1, y1, x2, y2))
    r = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    dx, dy = x2 - x1, y2 - y1
    size = dx * dx + dy * dy
    with np.errstate(all="ignore"):
        bounds = []
        for x, y in ((x1, y1), (x2, y2)):
            reach = np.where(np.abs(r - y) <= half + 1e-9, np.sqrt(np.maximum(half * half - (r - y) ** 2, 0)), np.nan)
            bounds += [x - reach, x + reach]
        ox, oy = -dy / np.sqrt(size) * half, dx / np.sqrt(size) * half
        corners = [(x1 + ox, y1 + oy), (x2 + ox, y2 + oy), (x2 - ox, y2 - oy), (x1 - ox, y1 - oy)]
        for (xa, ya), (xb, yb) in zip(corners, corners[1:] + corners[:1], strict=True):
            f = (r - ya) / (yb - ya)
            bounds.append(np.where((f >= 0) & (f <= 1), xa + f * (xb - xa), np.nan))
        left, right = np.fmin.reduce(bounds), np.fmax.reduce(bounds)

        def near(c: np.ndarray) -> np.ndarray:
            t = np.where(size == 0, 0.0, np.clip(((c - x1) * dx + (r - y1) * dy) / size, 0.0, 1.0))
            return ((c - x1) - t * dx) ** 2 + ((r - y1) - t * dy) ** 2 <= half * half

        first, last = np.ceil(left - 1e-6), np.floor(right + 1e-6)
        first = np.where(near(first), first, first + 1)
        last = np.where(near(last), last, last - 1)
        some = (first <= last) & near(first) & near(last)
    return of[some], r[some], first[some].astype(np.int64), last[some].astype(np.int64) + 1


def merged(of: np.ndarray, r: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of one line and row that meet or overlap, as one."""
    if not len(of):
        return of, r, c0, c1
    order = np.lexsort((c0, r, of))
    of, r, c0, c1 = of[order], r[order], c0[order], c1[order]
    row = np.cumsum((np.diff(of, prepend=of[0]) != 0) | (np.diff(r, prepend=r[0]) != 0))
    # The furthest end so far in each row: rows are set apart by more than any of them is wide.
    apart = row * (c1.max() - c0.min() + 1)
    upto = np.maximum.accumulate(c1 + apart) - apart
    new = np.ones(len(of), bool)
    new[1:] = (row[1:] != row[:-1]) | (c0[1:] > upto[:-1])
    starts = np.flatnonzero(new)
    return of[starts], r[starts], c0[starts], upto[np.append(starts[1:], len(of)) - 1]


def thick_lines(segments: DataFrame, half: float) -> DataFrame:
    """Cells (r, c) whose centre is within ``half`` cells of a segment (line, x1, y1, x2, y2), with its class if it has one."""
    runs = thick_runs(segments, half)
    return runs.withColumn("c", F.explode(F.sequence(F.col("c0"), F.col("c1") - 1))).drop("c0", "c1")


def thick_cells(segments: DataFrame, half: float) -> DataFrame:
    """How many cells ``thick_lines`` gives each line (line, cells)."""
    return thick_runs(segments, half).groupBy("line").agg(F.sum(F.col("c1") - F.col("c0")).alias("cells"))


#: Paint order of the raster classes, last on top: farmland, forest, road, building, water.
PAINT_ORDER = (4, 5, 1, 2, 3)


def paint(cells: DataFrame) -> DataFrame:
    """One class per cell (r, c, class): the one painted last."""
    rank = F.array_position(F.array(*map(F.lit, PAINT_ORDER)), F.col("class"))
    return cells.groupBy("r", "c").agg(F.max_by("class", rank).alias("class"))


def resolve_ways(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ways as ordered coordinate arrays (way, n, coords); references to missing nodes are dropped."""
    return refs.join(nodes, "node").groupBy("way").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "east", "north"))), lambda p: F.struct(p["east"].alias("east"), p["north"].alias("north"))).alias("coords"))


def adjacent_tiles(tiles: DataFrame) -> DataFrame:
    """Pairs of tiles (x, y) that share an edge, the right or the lower one second."""
    a = tiles.select("x", "y")
    step = a.withColumn("d", F.explode(F.array(F.struct(F.lit(1).alias("x"), F.lit(0).alias("y")), F.struct(F.lit(0).alias("x"), F.lit(1).alias("y")))))
    asked = step.select("x", "y", (F.col("x") + F.col("d.x")).alias("x2"), (F.col("y") + F.col("d.y")).alias("y2"))
    return asked.join(a.withColumnsRenamed({"x": "x2", "y": "y2"}), ["x2", "y2"], "left_semi").select("x", "y", "x2", "y2")


def best_shift(a: DataFrame, b: DataFrame, reach: int) -> DataFrame:
    """Per image, the shift of ``b`` against ``a`` with the greatest mean product of standardised values.

    Pixels are shuffled once, by image.  A tile of ``a`` is a row with an array of
    the pixels of ``b`` around it, in which each shift is looked up.
    """
    w = W.partitionBy("image", "side")
    both = a.select("image", "r", "c", "v", F.lit(0).alias("side")).unionByName(b.select("image", "r", "c", "v", F.lit(1).alias("side"))).repartition("image")
    both = both.select("image", "side", "r", "c", F.try_divide(F.col("v") - F.avg("v").over(w), F.stddev_pop("v").over(w)).alias("s"))
    # Of a place each side has how many pixels, how many values and their sum.
    own = lambda i: (F.count_if(F.col("side") == i), F.count(F.when(F.col("side") == i, F.col("s"))), F.sum(F.when(F.col("side") == i, F.col("s"))))
    names = [f"{n}{i}" for i in (0, 1) for n in ("rows", "n", "s")]
    cells = both.groupBy("image", "r", "c").agg(*(e.alias(n) for n, e in zip(names, (*own(0), *own(1)), strict=True)))
    near = cells.select("image", *((F.col(k) + reach).alias(k) for k in "rc"), F.struct(*names).alias("p"))
    tiles = tiled(near, ["image"], ["p"], halo=2 * reach)
    mine = tiles.select("*", F.posexplode("p").alias("i", "x")).filter("x.rows0 > 0").withColumns({"r": F.col("r0") + F.floor(F.col("i") / F.col("w")), "c": F.col("c0") + F.col("i") % F.col("w")})
    mine = mine.filter((F.floor((F.col("r") - reach) / TILE) == F.col("tr")) & (F.floor((F.col("c") - reach) / TILE) == F.col("tc")))
    d = F.array(*map(F.lit, range(-reach, reach + 1)))
    met = mine.withColumn("dr", F.explode(d)).withColumn("dc", F.explode(d)).withColumn("y", in_tile("p", F.col("r") - F.col("dr"), F.col("c") - F.col("dc"))).filter("y.rows1 > 0")
    shifts = met.select("image", "dr", "dc", (F.col("x.n0") * F.col("y.n1")).alias("n"), (F.col("x.s0") * F.col("y.s1")).alias("sum"))
    score = shifts.groupBy("image", "dr", "dc").agg(F.try_divide(F.sum("sum"), F.sum("n")).alias("score"))
    return score.groupBy("image").agg(F.max(F.struct("score", (-F.abs("dr") - F.abs("dc")).alias("near"), "dr", "dc")).alias("m")).select("image", "m.dr", "m.dc", "m.score")


def rigid2d(pairs: DataFrame, by: list[str], similarity: bool = False) -> DataFrame:
    """Least-squares rotation, translation (and scale) of (ax, ay) onto (bx, by), in closed form from sums."""
    s = pairs.groupBy(*by).agg(
        F.count("*").alias("n"), *(F.avg(c).alias(f"m_{c}") for c in ("ax", "ay", "bx", "by_")),
        F.covar_pop("ax", "bx").alias("xx"), F.covar_pop("ay", "by_").alias("yy"), F.covar_pop("ax", "by_").alias("xy"), F.covar_pop("ay", "bx").alias("yx"),
        (F.var_pop("ax") + F.var_pop("ay")).alias("va"),
    )
    dot, cross = F.col("xx") + F.col("yy"), F.col("xy") - F.col("yx")
    k = F.coalesce(F.try_divide(F.hypot(dot, cross), F.col("va")), F.lit(1.0)) if similarity else F.lit(1.0)
    s = s.withColumns({"theta": F.atan2(cross, dot), "scale": k})
    c, n = F.col("scale") * F.cos("theta"), F.col("scale") * F.sin("theta")
    return s.select(*by, "n", "theta", "scale", (F.col("m_bx") - c * F.col("m_ax") + n * F.col("m_ay")).alias("tx"), (F.col("m_by_") - n * F.col("m_ax") - c * F.col("m_ay")).alias("ty"))
