"""Map packages and run results as tables: manifests, layers, series, configurations, foreign tile caches, control points.

Metadata is one JSON document a package or run, written and read by Spark as text; rasters are
tile tables (see ``records``).  What is not valid is an error and never mended.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import angles
from .records import read_window, write_tiles

CLASS_NAMES = ("background", "road", "building", "water", "farmland", "forest")
#: The kinds of entries of a manifest, by the pattern of a layer's name.
LAYER_KINDS = {"ortho": "^ortho_", "dem": "^dem$", "semantic": "^semantic$"}
#: What an entry of each kind must have, and the only value that it may be, as JSON.
RULES = (
    ("package", "crs", None), ("package", "origin", None), ("package", "layers", None),
    ("ortho", "provider", None),
    ("dem", "source", None), ("dem", "source_datum", None), ("dem", "vertical_datum", None), ("dem", "geoid_model", None),
    ("semantic", "source", None), ("semantic", "extract_date", None), ("semantic", "classes", json.dumps(list(CLASS_NAMES), separators=(",", ":"))),
)
#: Foreign tile caches, by how far their zoom is ahead and their file types.
CACHE_LAYOUTS = {"qgis_xyz": (0, ("jpg", "jpeg", "png", "image")), "sasplanet": (1, ("jpg", "jpeg", "png"))}


# ---------------------------------------------------------------- documents


def write_document(spark: SparkSession, value: dict, path: str) -> None:
    """One JSON document, keys sorted; numbers that are not finite become null."""
    text = json.dumps(finite(value), sort_keys=True, allow_nan=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str) -> dict:
    """The document at ``path``; an error if there is none or more than one."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} is not one document")
    return json.loads(rows[0]["value"])


def finite(value):
    """NaN and infinities to null, at any depth."""
    if isinstance(value, dict):
        return {k: finite(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [finite(v) for v in value]
    return None if isinstance(value, float) and (value != value or abs(value) == float("inf")) else value


def nested(column: str, path: str) -> Column:
    """The value at a dotted path of a JSON column, as text; null where there is none."""
    steps = "".join(f"['{p}']" for p in path.split("."))
    return F.get_json_object(column, f"${steps}")


# ---------------------------------------------------------------- manifests


def manifest_problems(manifests: DataFrame) -> DataFrame:
    """All that is wrong with manifests (package, value as JSON), a row each: package, layer (null for the package itself), field, problem.

    Every entry meets the rules of its kind by a join.  A problem is 'missing', 'other value' or,
    for a layer of no known kind, 'unknown layer'.  What is not JSON lacks everything.
    """
    text_map = "map<string,string>"
    whole = manifests.select("package", F.from_json("value", text_map).alias("entry"))
    named = whole.select("package", F.explode(F.from_json(F.col("entry")["layers"], text_map)).alias("layer", "text")).select("package", "layer", F.from_json("text", text_map).alias("entry"))
    kind = F.coalesce(*(F.when(F.col("layer").rlike(pattern), name) for name, pattern in LAYER_KINDS.items()), F.lit("unknown"))
    entries = whole.select("package", F.lit(None).cast("string").alias("layer"), "entry", F.lit("package").alias("kind")).unionByName(named.withColumn("kind", kind))
    rules = manifests.sparkSession.createDataFrame([*RULES, ("unknown", "", None)], "kind string, field string, only string")
    met = entries.join(F.broadcast(rules), "kind")  # a dozen rules
    has = F.coalesce(F.map_contains_key("entry", F.col("field")), F.lit(False))
    problem = F.when(F.col("kind") == "unknown", "unknown layer").when(~has, "missing").when(F.col("only").isNotNull() & ~F.coalesce(F.col("entry")[F.col("field")].eqNullSafe(F.col("only")), F.lit(False)), "other value")
    return met.select("package", "layer", F.nullif("field", F.lit("")).alias("field"), problem.alias("problem")).filter("problem IS NOT NULL")


def _refuse(manifests: DataFrame, shown: int = 20) -> None:
    """An error that names the first problems, if there are any."""
    found = manifest_problems(manifests).orderBy("package", "layer", "field").limit(shown).collect()
    if found:
        raise ValueError("; ".join(" ".join(str(x) for x in (r["package"], r["layer"], r["field"], r["problem"]) if x is not None) for r in found))


def save_manifest(spark: SparkSession, manifest: dict, path: str) -> None:
    """Write a manifest that follows the rules; else an error, and nothing is written."""
    _refuse(spark.createDataFrame([(path, json.dumps(finite(manifest)))], "package string, value string"))
    write_document(spark, manifest, path)


def load_manifest(spark: SparkSession, path: str) -> dict:
    """The manifest at ``path``; an error if it does not follow the rules."""
    found = read_document(spark, path)
    _refuse(spark.createDataFrame([(path, json.dumps(found))], "package string, value string"))
    return found


def layers(spark: SparkSession, manifest: dict) -> DataFrame:
    """The manifest's layers as a table: layer, file, crs, gsd, and the whole entry as JSON."""
    rows = [(n, v.get("file"), v.get("crs", manifest["crs"]), float(v["gsd"]) if v.get("gsd") is not None else None, json.dumps(v, sort_keys=True)) for n, v in sorted(manifest["layers"].items())]
    return spark.createDataFrame(rows, "layer string, file string, crs string, gsd double, entry string")


def open_layer(spark: SparkSession, root: str, manifest: dict, name: str, level: int, r0: int, c0: int, height: int, width: int, mode: str = "float32") -> DataFrame:
    """A rectangle of a layer's pixels, as float32, uint8 or gray (the mean of its bands is kept as one value already)."""
    if name not in manifest["layers"]:
        raise KeyError(f"no layer {name}")
    px = read_window(spark, f"{root}/{manifest['layers'][name]['file']}", name, level, r0, c0, height, width)
    return px.withColumn("v", pixel_mode(F.col("v"), mode))


def open_optional(spark: SparkSession, root: str, manifest: dict, name: str = "semantic", **window) -> DataFrame | None:
    """A layer that a package may lack: None then."""
    return open_layer(spark, root, manifest, name, **window) if name in manifest["layers"] else None


def pixel_mode(v: Column, mode: str) -> Column:
    """A raster value as gray (0 to 1), uint8 (clipped, cut off) or float32."""
    if mode not in ("gray", "uint8", "float32"):
        raise ValueError(f"unknown mode {mode!r}")
    whole = F.greatest(F.lit(0.0), F.least(F.lit(255.0), v))
    return (whole / 255).cast("float") if mode == "gray" else whole.cast("int") if mode == "uint8" else v.cast("float")


def _noted(manifest: dict, name: str, entry: dict) -> dict:
    return manifest | {"layers": manifest.get("layers", {}) | {name: entry | {"georef_bias": {"east": None, "north": None, "sigma": None}}}}


def with_ortho(manifest: dict, name: str, built: dict, provider: dict, capture_date: str | None = None) -> dict:
    """The manifest with an imagery layer: what was built (file, validity_file, gsd, native_gsd, zoom, expected, missing) by which provider."""
    tiles = {"expected": built["expected"], "fetched": built["expected"] - built["missing"], "missing": built["missing"]}
    fields = {k: built[k] for k in ("file", "validity_file", "gsd", "native_gsd")}
    return _noted(manifest, name, fields | {"provider": provider["id"], "license": provider["license"], "attribution": provider["attribution"], "capture_date": capture_date, "source_zoom": built["zoom"], "crs": manifest["crs"], "tiles": tiles})


def with_dem(manifest: dict, built: dict) -> dict:
    """The manifest with a height layer; several datasets are joined by a plus, none is unknown."""
    fields = {k: built[k] for k in ("file", "gsd", "native_gsd", "source_datum", "vertical_datum", "geoid_model")}
    return _noted(manifest, "dem", fields | {"source": "+".join(built["datasets"]) or "unknown", "crs": manifest["crs"], "resampling": "bilinear"})


def with_semantic(manifest: dict, built: dict, extract_date: str | None, source: str = "osm") -> dict:
    """The manifest with a class layer."""
    return _noted(manifest, "semantic", {"file": built["file"], "gsd": built["gsd"], "source": source, "extract_date": extract_date, "crs": manifest["crs"], "classes": list(CLASS_NAMES)})


def geotransform_problems(layers_: DataFrame, files: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(layer, field, expected, actual) where a file's origin or pixel size differs from the manifest's.

    Both have layer, origin_east, origin_north, gsd; files gsd_row too.  A layer without a file is missing throughout.
    """
    a = layers_.select("layer", *(F.col(c).cast("double").alias(f"a_{c}") for c in ("origin_east", "origin_north", "gsd")))
    b = files.select("layer", *(F.col(c).cast("double").alias(f"b_{c}") for c in ("origin_east", "origin_north", "gsd", "gsd_row")))
    pairs = [(c, f"a_{c}", f"b_{c}") for c in ("origin_east", "origin_north", "gsd")] + [("gsd_row", "a_gsd", "b_gsd_row")]
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.col(x).alias("expected"), F.col(y).alias("actual")) for n, x, y in pairs)))
    rows = a.join(b, "layer", "left").select("layer", each.alias("p")).select("layer", "p.*")
    off = F.abs(F.col("expected") - F.col("actual")) > tolerance * F.greatest(F.lit(1.0), F.abs("expected"))
    return rows.filter(F.col("actual").isNull() | off)


def coverage_problems(layers_: DataFrame, bounds: dict[str, float]) -> DataFrame:
    """Layers (layer, gsd, west, east, south, north) that do not cover the manifest's bounds within two pixels."""
    t = 2.0 * F.coalesce("gsd", F.lit(0.0))
    short = (F.col("west") - t > bounds["east_min"]) | (F.col("east") + t < bounds["east_max"]) | (F.col("south") - t > bounds["north_min"]) | (F.col("north") + t < bounds["north_max"])
    return layers_.filter(short).select("layer")


# ---------------------------------------------------------------- layers and tiles


def layer_tiles(expected: DataFrame, cached: DataFrame, spread: float = 8.0, repeats: int = 4, most: float = 0.2) -> DataFrame:
    """Tiles (x, y) to build a layer from, with state: ok, missing, or placeholder; in the order of x and y.

    ``cached`` has x, y, digest, spread.  If more than ``most`` of the expected tiles are
    placeholders, the query fails: the provider has no imagery there.
    """
    from ..operators.grids import placeholder_tiles

    blank = placeholder_tiles(cached, repeats, spread).select("x", "y", F.lit(True).alias("blank")).distinct()
    there = cached.select("x", "y", F.lit(True).alias("there")).distinct()
    rows = expected.select("x", "y").distinct().join(there, ["x", "y"], "left").join(blank, ["x", "y"], "left")
    share = rows.agg(F.avg(F.coalesce("blank", F.lit(False)).cast("double")).alias("share"))
    state = F.when(F.col("there").isNull(), "missing").when(F.col("blank"), "placeholder").otherwise("ok")
    refused = F.raise_error(F.concat(F.lit("too many placeholder tiles: "), F.col("share").cast("string"))).cast("string")
    checked = rows.withColumn("one", F.lit(1)).join(F.broadcast(share.withColumn("one", F.lit(1))), "one")  # one row
    return checked.select("x", "y", F.when(F.col("share") > most, refused).otherwise(state).alias("state")).orderBy("x", "y")


def place_tiles(grid: DataFrame, tiles: DataFrame, pixels: DataFrame, zone: int, z: int, size: int = 256) -> DataFrame:
    """A mosaic (r, c, v, valid) from map tiles: each grid cell (r, c, easting, northing) looks up the tile pixel under it.

    Cells over a tile that is not ok, or over none, are 0 and not valid (0; else 255).
    """
    from ..functions import geodesy

    at = grid.withColumn("__g", geodesy.utm_inverse(F.col("easting"), F.col("northing"), zone))
    n = float(2**z * size)
    at = at.withColumns({"__x": (F.degrees("__g.lon") + 180) / 360 * n, "__y": (1 - F.asinh(F.tan(F.col("__g.lat"))) / 3.141592653589793) / 2 * n})
    at = at.withColumns({"x": F.floor(F.col("__x") / size), "y": F.floor(F.col("__y") / size), "pr": F.floor(F.col("__y")) % size, "pc": F.floor(F.col("__x")) % size})
    px = pixels.select("x", "y", F.col("r").alias("pr"), F.col("c").alias("pc"), F.col("v").alias("__v"))
    met = at.join(tiles.filter("state = 'ok'").select("x", "y", F.lit(255).alias("__ok")), ["x", "y"], "left").join(px, ["x", "y", "pr", "pc"], "left")
    good = F.col("__ok").isNotNull() & F.col("__v").isNotNull()
    return met.select("r", "c", F.when(good, F.col("__v")).otherwise(0.0).alias("v"), F.when(good, 255).otherwise(0).alias("valid"))


def semantic_layer(documents: DataFrame, to_cell, road_half: float = 1.5) -> DataFrame:
    """Class raster (r, c, class) of map features in JSON: areas filled, roads and waterways drawn, later classes on top.

    ``to_cell`` maps columns lon and lat (degrees) to fractional columns x and y of the raster.
    """
    from ..operators import grids
    from .records import map_features

    nodes, ways = map_features(documents)
    refs = ways.select(F.col("id").alias("way"), F.posexplode("nodes").alias("pos", "node"))
    x, y = to_cell(F.col("lon"), F.col("lat"))
    lines = grids.resolve_ways(refs, nodes.select(F.col("id").alias("node"), x.alias("east"), y.alias("north"))).join(ways.select(F.col("id").alias("way"), "class"), "way")
    pts = lines.select("way", "class", F.posexplode("coords").alias("i", "a"), "coords").withColumn("b", F.get("coords", F.col("i") + 1)).filter("b IS NOT NULL")
    edges = pts.select("way", "class", F.col("a.east").alias("x1"), F.col("a.north").alias("y1"), F.col("b.east").alias("x2"), F.col("b.north").alias("y2"))
    closed = lines.filter(F.element_at("coords", 1) == F.element_at("coords", -1)).select("way")
    areas = grids.polygon_mask(edges.filter("class <> 1").join(closed, "way", "left_semi").withColumnRenamed("way", "ring")).join(ways.select(F.col("id").alias("ring"), "class"), "ring")
    drawn = grids.thick_lines(edges.filter("class IN (1, 3)").withColumnRenamed("way", "line"), road_half)
    return grids.paint(areas.select("r", "c", "class").union(drawn.select("r", "c", "class")))


def foreign_tiles(files: DataFrame, layout: str, zooms: tuple[int, int] = (0, 22), cached: DataFrame | None = None) -> DataFrame:
    """Tiles (z, x, y, path) of another program's cache, by their paths; those outside ``zooms`` or already cached (z, x, y) are left out."""
    if layout not in CACHE_LAYOUTS:
        raise ValueError(f"unknown layout {layout!r}")
    ahead, kinds = CACHE_LAYOUTS[layout]
    pattern = r"(?i)(?:^|[/\\])z?(\d{1,2})[/\\](\d+)[/\\](\d+)\.(" + "|".join(kinds) + ")$"
    part = lambda i: F.regexp_extract("path", pattern, i)
    got = files.filter(F.col("path").rlike(pattern)).select((part(1).cast("int") - ahead).alias("z"), part(2).cast("long").alias("x"), part(3).cast("long").alias("y"), "path")
    got = got.filter(F.col("z").between(*zooms)).groupBy("z", "x", "y").agg(F.min("path").alias("path"))
    return got if cached is None else got.join(cached.select("z", "x", "y").distinct(), ["z", "x", "y"], "left_anti")


def without_tombstones(store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A tile store (missing: whether a fetch had found nothing) without its marks of missing tiles, and how many there were."""
    gone = F.coalesce("missing", F.lit(False))
    return store.filter(~gone), store.agg(F.count_if(gone).alias("cleared"))


def source_of_tile(name: Column, prefixes: dict[str, str]) -> Column:
    """Which dataset a height tile is of, by the start of its name; unknown if of none."""
    out = F.lit("unknown")
    for prefix, source in prefixes.items():
        out = F.when(F.startswith(name, F.lit(prefix)), source).otherwise(out)
    return out


def with_margin(south: Column, north: Column, west: Column, east: Column, margin: float) -> tuple[Column, Column, Column, Column]:
    """A box wider by a margin all round: south, north, west, east."""
    return south - margin, north + margin, west - margin, east + margin


def box_name(prefix: str, kind: str, south: Column, north: Column, west: Column, east: Column, margin: float = 0.01) -> Column:
    """The file name of a clipped height raster: the same box, the same name."""
    return F.format_string(f"{prefix}_{kind}_S%.4f_N%.4f_W%.4f_E%.4f_DEM.tif", *with_margin(south, north, west, east, margin))


def tile_url(template: str, x: Column, y: Column, z: Column, subdomains: tuple[str, ...] = ("",), turn: Column | None = None) -> Column:
    """A template with {x}, {y}, {z} and {s} filled in; subdomains take turns."""
    out = F.lit(template)
    for name, value in (("{x}", x), ("{y}", y), ("{z}", z)):
        out = F.replace(out, F.lit(name), value.cast("string"))
    names = F.array(*map(F.lit, subdomains))
    return F.replace(out, F.lit("{s}"), F.element_at(names, F.pmod(turn if turn is not None else F.lit(0), F.lit(len(subdomains))).cast("int") + 1))


def cell_error(x: Column, y: Column, x2: Column, y2: Column) -> Column:
    """How far a pixel comes back from where it was, in pixels."""
    return F.hypot(x2 - x, y2 - y)


def shown(value: Column, digits: int = 3) -> Column:
    """A figure as text; a dash where there is none."""
    return F.coalesce(F.when(~F.isnan(value), F.format_number(value, digits)), F.lit("—"))


def write_control_points(points: DataFrame, path: str) -> None:
    """Control points (id, x, y, lon, lat) as CSV, nine decimals for degrees."""
    points.select("id", "x", "y", *(F.format_string("%.9f", c).alias(c) for c in ("lon", "lat"))).write.option("header", True).csv(path)


# ---------------------------------------------------------------- surfaces, series, results


def write_surface(cells: DataFrame, path: str, crs: str) -> None:
    """A surface model (r, c, z, confidence) as tiles, its frame beside every row."""
    both = cells.withColumns({"level": F.lit(0), "layer": F.lit("z"), "v": F.col("z").cast("double")}).unionByName(cells.withColumns({"level": F.lit(0), "layer": F.lit("confidence"), "v": F.col("confidence").cast("double")}))
    write_tiles(both.select("layer", "level", "r", "c", "v"), f"{path}/tiles")
    write_document(cells.sparkSession, {"format": "surface-1", "crs": crs}, f"{path}/frame")
    cells.sparkSession.range(1).select(F.lit(crs).alias("crs")).write.parquet(f"{path}/crs")


def read_surface(spark: SparkSession, path: str, crs: str | None = None) -> DataFrame:
    """The model, refused if its document, its table and ``crs`` do not all name one frame."""
    named = {read_document(spark, f"{path}/frame").get("crs"), *(r["crs"] for r in spark.read.parquet(f"{path}/crs").distinct().limit(3).collect())}
    if crs is not None:
        named.add(crs)
    if len(named) > 1:
        raise ValueError(f"the surface is in different frames: {', '.join(sorted(map(str, named)))}")
    px = spark.read.parquet(f"{path}/tiles").select("layer", F.explode("pixels").alias("p")).select("layer", "p.*")
    return px.groupBy("r", "c").agg(F.max(F.when(F.col("layer") == "z", F.col("v"))).alias("z"), F.max(F.when(F.col("layer") == "confidence", F.col("v"))).cast("int").alias("confidence"))


def surface_run(clouds: DataFrame, ground: DataFrame, gsd: float, range_max: float, **anchor) -> DataFrame:
    """Points (east, north, up, range_m) to a surface (r, c, z, confidence, n) whose ground meets another's (r, c, z)."""
    from ..operators import grids
    from ..operators.quantiles import same_keys

    cells = clouds.select(F.floor(F.col("north") / gsd).alias("r"), F.floor(F.col("east") / gsd).alias("c"), F.col("up").alias("z"), "range_m")
    made = grids.focal_median(grids.accumulate(cells, range_max=range_max)).select("r", "c", "z", "confidence", "n")
    offset = grids.vertical_offset(made, ground, **anchor)
    return same_keys(made, F.broadcast(offset), []).select("r", "c", (F.col("z") + F.col("shift_m")).alias("z"), "confidence", "n")


SERIES = "struct<times:array<double>,rotations:array<array<double>>,translations:array<array<double>>,mirror_z:boolean,scale:double>"


def series_to_json(nodes: DataFrame, run: str = "run_id", mirror: bool = False, scale: float = 1.0) -> DataFrame:
    """A run's nodes (t_s, rotation, translation) as one JSON document: run, value."""
    rows = nodes.groupBy(run).agg(F.array_sort(F.collect_list(F.struct("t_s", "rotation", "translation"))).alias("n"))
    parts = F.struct(F.col("n.t_s").alias("times"), F.col("n.rotation").alias("rotations"), F.col("n.translation").alias("translations"), F.lit(bool(mirror)).alias("mirror_z"), F.lit(float(scale)).alias("scale"))
    return rows.select(run, F.to_json(parts).alias("value"))


def series_from_json(documents: DataFrame, run: str = "run_id") -> DataFrame:
    """The way back: run, t_s, rotation, translation, mirror_z (false if not given) and scale (1 if not given)."""
    d = documents.select(run, F.from_json("value", SERIES).alias("d"))
    n = d.select(run, F.coalesce("d.mirror_z", F.lit(False)).alias("mirror_z"), F.coalesce("d.scale", F.lit(1.0)).alias("scale"), F.explode(F.arrays_zip(F.col("d.times").alias("t_s"), F.col("d.rotations").alias("rotation"), F.col("d.translations").alias("translation"))).alias("n"))
    return n.select(run, "n.*", "mirror_z", "scale")


def write_results(records: DataFrame, path: str) -> None:
    """Records as Parquet, and as CSV with nested values as JSON."""
    records.write.parquet(f"{path}/parquet")
    flat = [F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(c) for c, t in records.dtypes]
    records.select(*flat).write.option("header", True).csv(f"{path}/csv")


def check_config(config: dict, required: dict[str, type | tuple[type, ...]]) -> None:
    """Raise on a field that is missing, of another type, or a level or bound that makes no sense."""
    for name, kind in required.items():
        value = config
        for step in name.split("."):
            if not isinstance(value, dict) or step not in value:
                raise ValueError(f"the configuration has no {name}")
            value = value[step]
        if not isinstance(value, kind):
            raise ValueError(f"{name} is not of its kind")
    box = config.get("bounds")
    if box and not (box["west"] < box["east"] and box["south"] < box["north"]):
        raise ValueError("the bounds are empty")


def geoid_grid(spark: SparkSession, path: str | None) -> DataFrame:
    """The geoid's nodes (i, j, v); an error rather than a guess where there is no grid."""
    if not path:
        raise ValueError("no geoid grid is given")
    grid = spark.read.parquet(path).select("i", "j", "v")
    if grid.isEmpty():
        raise ValueError(f"the geoid grid {path} is empty")
    return grid


def refined_fix(refined: DataFrame, gsd: float, bias_m: float = 0.0, floor_m: float = 0.0, floor_rad: float = 0.0) -> DataFrame:
    """Refined motions in pixels (dx, dy, yaw, cov_* in pixels) as fixes in metres: rows go south, so the turn changes sign."""
    from ..functions import covariance

    c = {k: F.col(f"cov_{k}") * (gsd if k in ("ey", "ny") else 1.0 if k == "yy" else gsd * gsd) for k in covariance.UPPER}
    c = covariance.floored(covariance.add_systematic(c, bias_m), floor_m, floor_rad)
    return refined.withColumns({"delta_east": F.col("dx") * gsd, "delta_north": F.col("dy") * gsd, "delta_yaw": angles.normalize(-F.col("yaw")), **{f"cov_{k}": v for k, v in c.items()}})


def best_fix(coarse: DataFrame, refined: DataFrame, by: list[str]) -> DataFrame:
    """The refined fix where it converged, else the coarse one (delta_east, delta_north, delta_yaw); refined tells which."""
    cols = ("delta_east", "delta_north", "delta_yaw")
    b = refined.filter("converged").select(*by, *(F.col(c).alias(f"__{c}") for c in cols), F.lit(True).alias("__r"))
    met = coarse.join(b, by, "left")
    return met.select(*by, *(F.coalesce(f"__{c}", c).alias(c) for c in cols), F.coalesce("__r", F.lit(False)).alias("refined"))
