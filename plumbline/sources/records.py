"""Readers and writers: record tables as CSV and Parquet, summaries as JSON, map features, rasters.

Schemas are explicit; nothing is inferred.  Missing stays null and is never made up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.metrics import class_of_tags


_KINDS = {"string": T.StringType(), "double": T.DoubleType(), "long": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType()}


def _struct(text: str) -> T.StructType:
    """Fields written as ``name kind, ...``; needs no session."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (f.split() for f in text.split(", "))])


_HEAD = "run_id string, level string, target string, t_s double, "
_COV = "cov_ee double, cov_en double, cov_ey double, cov_nn double, cov_ny double, cov_yy double, "
FIXES = _struct(
    _HEAD + "attempt_index long, channel int, accepted boolean, gt_east double, gt_north double, gt_yaw double, est_east double, est_north double, est_yaw double, "
    + _COV + "bias_east double, bias_north double, terrain string, n_correspondences long, n_inliers long, inlier_ratio double, covisibility double, peak_ratio double, "
    "residual_rms_px double, spatial_spread double, mean_confidence double, scale_check double, latency_ms double"
)
TRACK = _struct(_HEAD + "gt_east double, gt_north double, gt_yaw double, est_east double, est_north double, est_yaw double, " + _COV + "path_m double, terrain string")


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def truth(text: Column) -> Column:
    """Boolean of 1, 0, true, false in any case; anything else is null."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("1", "true"), True).when(t.isin("0", "false"), False)


def read_records(spark: SparkSession, path: str, schema: T.StructType = FIXES) -> DataFrame:
    """A CSV record table with a header; booleans may be digits."""
    raw = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.BooleanType) else f.dataType) for f in schema])
    df = spark.read.schema(raw).option("header", True).csv(path)
    return df.select(*((truth(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.BooleanType) else F.col(f.name)) for f in schema))


def write_records(df: DataFrame, path: str) -> None:
    """The same table as CSV: six decimals, digits for booleans."""
    def cell(f: T.StructField) -> Column:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return F.format_string("%.6f", c).alias(f.name) if not f.nullable else F.when(c.isNotNull(), F.format_string("%.6f", c)).alias(f.name)
        return c.cast("int").alias(f.name) if isinstance(f.dataType, T.BooleanType) else c

    df.select(*(cell(f) for f in df.schema)).write.option("header", True).csv(path)


def stem(path: Column) -> Column:
    """Path without .csv, .fixes.csv or .trajectory.csv."""
    return F.regexp_replace(path, r"(\.(trajectory|fixes))?\.csv$", "")


def check_contract(df: DataFrame, schema: T.StructType, finite: tuple[str, ...]) -> None:
    """Raise if the columns differ from ``schema`` or a column of ``finite`` has a null, NaN or infinity."""
    if [(f.name, f.dataType) for f in df.schema] != [(f.name, f.dataType) for f in schema]:
        raise ValueError("the table does not have the contract's columns")
    bad = F.lit(False)
    for c in finite:
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    if not df.filter(bad).isEmpty():
        raise ValueError(f"not finite: {', '.join(finite)}")


def finite_or_null(df: DataFrame) -> DataFrame:
    """NaN and infinities to null in double columns, for JSON."""
    ok = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).alias(c)
    return df.select(*((ok(c) if t == "double" else F.col(c)) for c, t in df.dtypes))


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON document per row, nulls written out."""
    clean = finite_or_null(df)
    return clean.select(F.to_json(F.struct(*sorted(clean.columns)), {"ignoreNullFields": "false"}).alias("value"))


def append_trend(summary: DataFrame, store: str) -> None:
    """Add a run's figures to the trend store, which may gain columns with a run."""
    summary.write.mode("append").parquet(store)


def read_trend(spark: SparkSession, store: str) -> DataFrame:
    """All runs of the trend store; a figure that a run did not have is null."""
    return spark.read.option("mergeSchema", "true").parquet(store)


def latest(meta: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row per key: an upsert over an append-only store."""
    whole = F.struct(order, *(c for c in meta.columns if c not in keys and c != order))
    return meta.groupBy(*keys).agg(F.max(whole).alias("m")).select(*keys, "m.*")


def by_priority(tiles: DataFrame, keys: list[str], priority: str) -> DataFrame:
    """The row of the best (least) priority per key: fallback between sources."""
    whole = F.struct(priority, *(c for c in tiles.columns if c not in keys and c != priority))
    return tiles.groupBy(*keys).agg(F.min(whole).alias("m")).select(*keys, "m.*")


_ELEMENT = "array<struct<type:string,id:bigint,lat:double,lon:double,nodes:array<bigint>,tags:map<string,string>>>"


def map_features(documents: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Nodes (id, lat, lon) and classified ways (id, class, nodes) of feature-query results in JSON."""
    e = documents.select(F.explode(F.from_json(column, f"struct<elements:{_ELEMENT}>")["elements"]).alias("e")).select("e.*")
    nodes = e.filter("type = 'node'").select("id", "lat", "lon").dropDuplicates(["id"])
    ways = e.filter("type = 'way'").select("id", class_of_tags(F.col("tags")).alias("class"), "nodes").filter("class IS NOT NULL")
    return nodes, ways


_POLYGON = "struct<type:string,coordinates:string,geometries:array<struct<type:string,coordinates:string>>,features:array<struct<geometry:struct<type:string,coordinates:string>>>>"


def rings(documents: DataFrame, column: str = "value") -> DataFrame:
    """Outer rings (ring, coords) of GeoJSON Polygon, MultiPolygon, GeometryCollection and FeatureCollection texts."""
    g = documents.select(F.from_json(column, _POLYGON).alias("g"))
    one = F.array(F.struct(F.col("g.type").alias("type"), F.col("g.coordinates").alias("coordinates")))
    many = F.coalesce("g.geometries", F.transform("g.features", lambda f: f["geometry"]), one)
    shapes = g.select(F.explode(many).alias("s")).select("s.*")
    ring = "array<array<double>>"
    single = shapes.filter("type = 'Polygon'").select(F.from_json("coordinates", f"array<{ring}>")[0].alias("coords"))
    multi = shapes.filter("type = 'MultiPolygon'").select(F.explode(F.from_json("coordinates", f"array<array<{ring}>>")).alias("p")).select(F.col("p")[0].alias("coords"))
    return single.union(multi).withColumn("ring", F.xxhash64(F.to_json("coords")))


def read_raw_images(spark: SparkSession, path: str, height: int, width: int) -> DataFrame:
    """Files of little-endian doubles, row-major, as a pixel table (path, r, c, v); a file of another size is an error."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                v = np.frombuffer(content, "<f8")
                if len(v) != height * width:
                    raise ValueError(f"{name} has {len(v)} values")
                r, c = np.divmod(np.arange(len(v)), width)
                yield pd.DataFrame({"path": name, "r": r, "c": c, "v": v})

    return files.mapInPandas(kernel, "path string, r long, c long, v double")


def write_tiles(pixels: DataFrame, path: str, size: int = 256) -> None:
    """A pixel table (layer, level, r, c, v) as tiles: one row per tile, sorted so that row groups prune."""
    t = pixels.withColumns({"ty": F.floor(F.col("r") / size), "tx": F.floor(F.col("c") / size)})
    tiles = t.groupBy("layer", "level", "ty", "tx").agg(F.array_sort(F.collect_list(F.struct("r", "c", "v"))).alias("pixels"))
    tiles.repartitionByRange("layer", "level", "ty", "tx").sortWithinPartitions("level", "ty", "tx").write.partitionBy("layer").parquet(path)


def read_window(spark: SparkSession, path: str, layer: str, level: int, r0: int, c0: int, height: int, width: int, size: int = 256) -> DataFrame:
    """Pixels of a rectangle; only the tiles that it touches are read."""
    t = spark.read.parquet(path).filter((F.col("layer") == layer) & (F.col("level") == level))
    t = t.filter(F.col("ty").between(r0 // size, (r0 + height - 1) // size) & F.col("tx").between(c0 // size, (c0 + width - 1) // size))
    p = t.select(F.explode("pixels").alias("p")).select("p.*")
    return p.filter(F.col("r").between(r0, r0 + height - 1) & F.col("c").between(c0, c0 + width - 1))
