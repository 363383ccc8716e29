"""Map windows, quads, tile stores and height datums over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geodesy
from . import grids


def in_quad(px: Column, py: Column, corners: list[tuple[Column, Column]]) -> Column:
    """Whether a point is inside a convex quad, whichever way round its corners go; edges count as inside."""
    sides = []
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1], strict=True):
        sides.append((x2 - x1) * (py - y1) - (y2 - y1) * (px - x1))
    left, right = sides[0] >= 0, sides[0] <= 0
    for s in sides[1:]:
        left, right = left & (s >= 0), right & (s <= 0)
    return left | right


def extract_window(centres: DataFrame, cells: DataFrame, reach: int, toward_zero: bool = False, value: str = "v", fill: float = 0.0) -> DataFrame:
    """The square of cells around each centre (id, x, y): dr, dc and the value, ``fill`` where there is no cell.

    Coordinates are floored to cells; with ``toward_zero`` they are cut off as integers are.
    A cell is there once.  A centre meets one tile of cells, which has those around it too, and
    its square is made in its row.
    """
    halo = reach + 1  # floor(y + dr) may be one off floor(y) + dr
    near = cells.select((F.col("r") + halo).alias("r"), (F.col("c") + halo).alias("c"), F.col(value).alias("__v"))
    tiles = grids.tiled(near, [], ["__v"], halo=2 * halo)
    at = centres.withColumns({"tr": F.floor(F.floor("y") / grids.TILE), "tc": F.floor(F.floor("x") / grids.TILE)})
    cell = (lambda v: v.cast("long")) if toward_zero else F.floor
    d = F.sequence(F.lit(-reach), F.lit(reach))
    rows = at.join(tiles, ["tr", "tc"], "left").withColumn("dr", F.explode(d)).withColumn("dc", F.explode(d))
    found = grids.in_tile("__v", cell(F.col("y") + F.col("dr")) + halo, cell(F.col("x") + F.col("dc")) + halo)
    return rows.select("id", "dr", "dc", F.coalesce(found, F.lit(fill)).alias(value))


def sample_density(pixels: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Source samples per target pixel: the Jacobian determinant of (u, v) by central, at borders one-sided, differences."""
    row, col = W.partitionBy("image", "r").orderBy("c"), W.partitionBy("image", "c").orderBy("r")

    def slope(a: str, w) -> Column:
        lo, hi = F.lag(a).over(w), F.lead(a).over(w)
        return F.when(lo.isNull(), hi - F.col(a)).when(hi.isNull(), F.col(a) - lo).otherwise((hi - lo) / 2)

    return pixels.withColumn("density", F.abs(slope(u, row) * slope(v, col) - slope(u, col) * slope(v, row)))


def nearest_cell(points: DataFrame, grid: DataFrame, origin: tuple[float, float], step: float, size: tuple[int, int], value: str = "v") -> DataFrame:
    """Value of the nearest grid node (i, j) to each point (x, y), clamped to the grid."""
    at = lambda c, o, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.rint((F.col(c) - o) / step).cast("long")))
    placed = points.withColumns({"i": at("x", origin[0], size[0]), "j": at("y", origin[1], size[1])})
    return placed.join(grid.select("i", "j", value), ["i", "j"], "left").drop("i", "j")


def orthometric_to_ellipsoidal(h: Column, undulation: Column) -> Column:
    return h + undulation


def ellipsoidal_to_orthometric(h: Column, undulation: Column) -> Column:
    return h - undulation


def shared_edge(x: Column, y: Column, x2: Column, y2: Column, z: Column) -> Column:
    """End points, in web-mercator metres, of the edge between a tile and its right or lower neighbour."""
    a, b = geodesy.tile_bounds(x, y, z), geodesy.tile_bounds(x2, y2, z)
    right = x2 == x + 1
    return F.struct(
        F.when(right, a["east"]).otherwise(a["west"]).alias("x1"), F.when(right, a["north"]).otherwise(b["north"]).alias("y1"),
        F.when(right, a["east"]).otherwise(a["east"]).alias("x2"), F.when(right, a["south"]).otherwise(b["north"]).alias("y2"),
    )


def edge_cells(edges: DataFrame, brush: int = 1) -> DataFrame:
    """Cells that a line (line, x1, y1, x2, y2), drawn with a square brush, covers."""
    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))))).cast("long")
    lines = edges.groupBy("line").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2", n.alias("n"))).alias("e"))
    # A line's cells are an array of its row, as whole numbers; those of other lines never meet them.
    covered = f"""array_distinct(flatten(transform(e, e -> flatten(transform(sequence(0L, e.n), k -> flatten(transform(sequence(-{brush}, {brush}), dr -> transform(sequence(-{brush}, {brush}), dc ->
        (floor(e.y1 + k / e.n * (e.y2 - e.y1)) + dr) * {grids.SPAN} + floor(e.x1 + k / e.n * (e.x2 - e.x1)) + dc))))))))"""
    cells = lines.select("line", F.explode(F.expr(covered)).alias("key")).filter("key IS NOT NULL").withColumn("r", grids.row_of(F.col("key")))
    return cells.select("line", "r", (F.col("key") - F.col("r") * grids.SPAN).alias("c"))


def missing(requests: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Requests that the cache doesn't hold."""
    return requests.join(cache.select(*keys).distinct(), keys, "left_anti")


def cached(requests: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Requests that the cache holds."""
    return requests.join(cache.select(*keys).distinct(), keys, "left_semi")


def every_kth(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """At most ``most`` rows at even steps of the order; ranks come from range-partitioned counts, not one window."""
    n = rows.count()
    step = max(1, -(-n // most)) if n else 1
    return _ranked(rows, order).filter((F.col("rank") - 1) % step == 0).drop("rank").orderBy(*order).limit(most)


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Global rank: rows are sorted by range, counted per partition, and numbered within it.

    The partitions are used twice and must be the same: they are checkpointed where the session
    has a folder for that, else kept.
    """
    held = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    held = held.checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else held.persist()
    counts = held.groupBy("__p").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = held.withColumn("k", F.row_number().over(W.partitionBy("__p").orderBy(*order)))
    return inside.join(before.select("__p", "before"), "__p").withColumn("rank", F.col("before") + F.col("k")).drop("__p", "before", "k")


def finest_usable(probes: DataFrame, least_share: float) -> DataFrame:
    """The greatest zoom whose share of good probes (z, ok) is enough, else the least one probed."""
    per = probes.groupBy("z").agg(F.avg(F.col("ok").cast("double")).alias("share"))
    return per.agg(F.coalesce(F.max(F.when(F.col("share") >= least_share, F.col("z"))), F.min("z")).alias("z"))


def layer_problems(layers: DataFrame, crs: str, required: tuple[str, ...]) -> DataFrame:
    """A row per problem of a package's layers: another CRS, or a required field that is null."""
    checks = [F.when(F.col("crs") != crs, F.lit("crs"))] + [F.when(F.col(c).isNull(), F.lit(f"no {c}")) for c in required]
    return layers.select("layer", F.explode(F.filter(F.array(*checks), lambda p: p.isNotNull())).alias("problem"))
