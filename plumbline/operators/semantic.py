"""Matching of class masks: exact distances, chamfer and overlap surfaces over a grid of shifts.

Masks are tables (image, r, c) of set cells, or (image, r, c, on) where all cells are listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lower_envelope(at: np.ndarray, height: np.ndarray) -> np.ndarray:
    """For each place of ``at`` (ascending) the least of (x - at[i])**2 + height[i] over i; height inf has no parabola."""
    out = np.full(len(at), np.inf)
    kept = np.flatnonzero(np.isfinite(height))
    if not len(kept):
        return out
    hull: list[int] = []
    begins: list[float] = []  # where each parabola of the hull takes over
    for i in kept.tolist():
        begin = -np.inf
        while hull:
            j = hull[-1]
            begin = ((height[i] + at[i] * at[i]) - (height[j] + at[j] * at[j])) / (2.0 * (at[i] - at[j]))
            if begin > begins[-1]:
                break
            hull.pop()
            begins.pop()
            begin = -np.inf
        hull.append(i)
        begins.append(begin)
    own = np.array(hull)[np.searchsorted(np.array(begins), at, side="right") - 1]
    return (at - at[own]) ** 2 + height[own]


def distances(cells: DataFrame) -> DataFrame:
    """Squared distance d2 of each cell (image, r, c, on) to the nearest that is on; null in an image without one.

    Along columns by the nearest on either side, then along rows by lower envelopes of
    parabolas; a task holds one row of an image at a time.
    """
    column = W.partitionBy("image", "c")
    up, down = (F.last(F.when(F.col("on"), F.col("r")), ignorenulls=True).over(column.orderBy(o).rowsBetween(W.unboundedPreceding, W.currentRow)) for o in (F.asc("r"), F.desc("r")))
    near = cells.withColumns({"__u": F.col("r") - up, "__d": down - F.col("r")}).select("image", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.least("__u", "__d").cast("double").alias("g"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(table: pa.Table) -> pa.RecordBatch:
            t = table.combine_chunks()
            at, g = t["c"].to_numpy().astype(np.float64), t["g"].to_numpy(zero_copy_only=False).astype(np.float64)
            image, r = t["image"].to_numpy(zero_copy_only=False), t["r"].to_numpy()
            edge = np.flatnonzero((image[1:] != image[:-1]) | (r[1:] != r[:-1])) + 1
            height = np.where(np.isnan(g), np.inf, g * g)
            d2 = np.concatenate([lower_envelope(at[a:b], height[a:b]) for a, b in zip([0, *edge], [*edge, len(at)], strict=True)])
            none = ~np.isfinite(d2)
            return pa.RecordBatch.from_arrays([*(pa.concat_arrays(t[k].chunks) for k in ("image", "r", "c")), pa.array(np.where(none, 0, d2).astype(np.int64), mask=none)], ["image", "r", "c", "d2"])

        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            last = (table["image"][-1].as_py(), table["r"][-1].as_py())
            k = table.num_rows
            while k and (table["image"][k - 1].as_py(), table["r"][k - 1].as_py()) == last:
                k -= 1
            if k:
                yield solved(table.slice(0, k))
            held = table.slice(k)
        if held is not None and held.num_rows:
            yield solved(held)

    kind = dict(near.dtypes)["image"]
    return near.repartition("image", "r").sortWithinPartitions("image", "r", "c").mapInArrow(kernel, f"image {kind}, r long, c long, d2 long")


def shifts(reach: int) -> Column:
    """A row for each shift along one axis."""
    return F.explode(F.sequence(F.lit(-reach), F.lit(reach)))


def chamfer_surface(cells: DataFrame, edges: DataFrame, reach: int) -> DataFrame:
    """Mean distance to the mask ``cells`` of the ``edges`` (image, r, c), for each shift of them up to ``reach`` (image, dr, dc, n, chamfer).

    Edges that a shift takes off the image do not count; n has the rest.  A cell is met by
    equality, once for each shift.
    """
    sent = edges.select("image", "r", "c").withColumn("dr", shifts(reach)).withColumn("dc", shifts(reach))
    sent = sent.select("image", (F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c"), "dr", "dc")
    met = sent.join(distances(cells), ["image", "r", "c"])
    return met.groupBy("image", "dr", "dc").agg(F.count("*").alias("n"), F.avg(F.sqrt(F.col("d2").cast("double"))).alias("chamfer"))


def runs(mask: DataFrame) -> DataFrame:
    """Runs of set cells along rows (image, r, c0, c1; c1 is past the end)."""
    at = W.partitionBy("image", "r").orderBy("c")
    rows = mask.select("image", "r", "c").withColumn("__g", F.col("c") - F.row_number().over(at))
    return rows.groupBy("image", "r", "__g").agg(F.min("c").alias("c0"), (F.max("c") + 1).alias("c1")).drop("__g")


def overlap_surface(a: DataFrame, b: DataFrame, reach: int) -> DataFrame:
    """Intersection over union of masks ``a`` and ``b`` (image, r, c) for each shift of ``b`` up to ``reach`` (image, dr, dc, iou).

    Runs of a row meet those of the shifted row, and the cells that two runs share follow from
    their ends, so work is pairs of runs times shifts.  Nothing in common is 0, nothing at all null.
    """
    area = lambda m, n: m.groupBy("image").agg(F.count("*").alias(n))
    moved = runs(b).withColumn("dr", shifts(reach)).select("image", (F.col("r") + F.col("dr")).alias("r"), "dr", F.col("c0").alias("b0"), F.col("c1").alias("b1"))
    near = runs(a).join(moved, ["image", "r"]).filter((F.col("b0") - reach < F.col("c1")) & (F.col("b1") + reach > F.col("c0"))).withColumn("dc", shifts(reach))
    shared = F.greatest(F.least("c1", F.col("b1") + F.col("dc")) - F.greatest("c0", F.col("b0") + F.col("dc")), F.lit(0))
    both = near.groupBy("image", "dr", "dc").agg(F.sum(shared).alias("__i"))
    grid = area(a, "__a").join(area(b, "__b"), "image", "full").withColumn("dr", shifts(reach)).withColumn("dc", shifts(reach))
    made = grid.join(both, ["image", "dr", "dc"], "left").withColumn("__i", F.coalesce("__i", F.lit(0)))
    total = F.coalesce("__a", F.lit(0)) + F.coalesce("__b", F.lit(0)) - F.col("__i")
    return made.select("image", "dr", "dc", F.try_divide(F.col("__i").cast("double"), total).alias("iou"))


#: How much a class tells of a place: road, building, water, farmland, forest.
WEIGHTS = {1: 1.0, 2: 0.6, 3: 1.0, 4: 0.2, 5: 0.3}


def semantic_fix(overlaps: DataFrame, weights: dict[int, float] = WEIGHTS, least: float = 1.0) -> DataFrame:
    """The best shift from overlap surfaces by class (image, class, dr, dc, iou).

    Per image: dr, dc, score (mean of iou by class weight), sharpness (over the best score that
    is not next to it; null without one), classes (how many have any overlap there), confident
    (their weights come to ``least``) and fix_type, which is 2 and never higher: the channel
    bounds a drift, it does not correct it.  Ties go to the least shift, then to the greater one.
    """
    weight = F.coalesce(F.create_map(*(F.lit(x) for k, w in weights.items() for x in (k, w)))[F.col("class")], F.lit(0.0))
    some = F.coalesce(F.col("iou") > 0, F.lit(False))
    score = overlaps.withColumn("__w", weight).groupBy("image", "dr", "dc").agg(
        F.try_divide(F.sum(F.col("__w") * F.coalesce("iou", F.lit(0.0))), F.sum("__w")).alias("score"), F.count_if(some).alias("classes"), F.sum(F.when(some, F.col("__w")).otherwise(0.0)).alias("__told")
    )
    near = (-F.abs("dr") - F.abs("dc")).alias("near")
    # Surfaces are small and of fixed size: at most (2 reach + 1) ** 2 shifts an image.
    best = score.groupBy("image").agg(F.max(F.struct("score", near, "dr", "dc", "classes", "__told")).alias("m"), F.collect_list(F.struct("score", "dr", "dc")).alias("all"))
    away = F.filter("all", lambda x: (F.abs(x["dr"] - F.col("m.dr")) > 1) | (F.abs(x["dc"] - F.col("m.dc")) > 1))
    second = F.array_max(F.transform(away, lambda x: x["score"]))
    return best.select("image", "m.dr", "m.dc", "m.score", F.try_divide(F.col("m.score"), second).alias("sharpness"), "m.classes", (F.col("m.__told") >= least).alias("confident"), F.lit(2).alias("fix_type"))
