"""WGS84, UTM and map-tile arithmetic as Column functions.  Angles are in radians unless a name says degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

A, FLAT = 6378137.0, 1 / 298.257223563
E2 = FLAT * (2 - FLAT)
B = A * (1 - FLAT)
E1 = math.sqrt(E2)
K0, FALSE_EAST, FALSE_NORTH_SOUTH = 0.9996, 500000.0, 10000000.0
MAX_LAT = 85.0511287798066
HALF_CIRCLE = math.pi * A
TILE_SIZE = 256
_N = FLAT / (2 - FLAT)
#: Kruger's series in the third flattening, by order; polynomials evaluated below.
RECTIFYING = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256 + 25 * _N**8 / 16384)


def _series() -> tuple[list[float], list[float]]:
    """Forward and inverse coefficients to sixth order in n (below a nanometre within a zone)."""
    n = _N
    forward = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180 - 127 * n**5 / 288 + 7891 * n**6 / 37800,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440 + 281 * n**5 / 630 - 1983433 * n**6 / 1935360,
        61 * n**3 / 240 - 103 * n**4 / 140 + 15061 * n**5 / 26880 + 167603 * n**6 / 181440,
        49561 * n**4 / 161280 - 179 * n**5 / 168 + 6601661 * n**6 / 7257600,
        34729 * n**5 / 80640 - 3418889 * n**6 / 1995840,
        212378941 * n**6 / 319334400,
    ]
    inverse = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360 - 81 * n**5 / 512 + 96199 * n**6 / 604800,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440 + 46 * n**5 / 105 - 1118711 * n**6 / 3870720,
        17 * n**3 / 480 - 37 * n**4 / 840 - 209 * n**5 / 4480 + 5569 * n**6 / 90720,
        4397 * n**4 / 161280 - 11 * n**5 / 504 - 830251 * n**6 / 7257600,
        4583 * n**5 / 161280 - 108847 * n**6 / 3991680,
        20648693 * n**6 / 638668800,
    ]
    return forward, inverse


ALPHA, BETA = _series()


def ecef(lat: Column, lon: Column, alt: Column) -> Column:
    """Geodetic to earth-centred x, y, z."""
    n = F.lit(A) / F.sqrt(1 - E2 * F.sin(lat) * F.sin(lat))
    return F.struct(((n + alt) * F.cos(lat) * F.cos(lon)).alias("x"), ((n + alt) * F.cos(lat) * F.sin(lon)).alias("y"), ((n * (1 - E2) + alt) * F.sin(lat)).alias("z"))


def geodetic(x: Column, y: Column, z: Column) -> Column:
    """Earth-centred to lat, lon, alt: Bowring's start and two refinements; on the axis, the pole."""
    r = F.hypot(x, y)
    th = F.atan2(A * z, B * r)
    ep2 = (A * A - B * B) / (B * B)
    lat = F.atan2(z + ep2 * B * F.pow(F.sin(th), F.lit(3.0)), r - E2 * A * F.pow(F.cos(th), F.lit(3.0)))
    for _ in range(2):
        n = F.lit(A) / F.sqrt(1 - E2 * F.sin(lat) * F.sin(lat))
        lat = F.atan2(z, r * (1 - E2 * n / (r / F.cos(lat))))
    alt = r / F.cos(lat) - F.lit(A) / F.sqrt(1 - E2 * F.sin(lat) * F.sin(lat))
    pole = r < 1e-12
    return F.struct(
        F.when(pole, F.when(z >= 0, F.lit(math.pi / 2)).otherwise(F.lit(-math.pi / 2))).otherwise(lat).alias("lat"),
        F.atan2(y, x).alias("lon"),
        F.when(pole, F.abs(z) - B).otherwise(alt).alias("alt"),
    )


def _anchor(lat0: float, lon0: float, alt0: float) -> tuple[list[list[float]], list[float]]:
    sl, cl, so, co = math.sin(lat0), math.cos(lat0), math.sin(lon0), math.cos(lon0)
    n = A / math.sqrt(1 - E2 * sl * sl)
    return [[-so, co, 0.0], [-sl * co, -sl * so, cl], [cl * co, cl * so, sl]], [(n + alt0) * cl * co, (n + alt0) * cl * so, (n * (1 - E2) + alt0) * sl]


def to_enu(lat: Column, lon: Column, alt: Column, anchor: tuple[float, float, float]) -> Column:
    """East, north, up around an anchor (lat, lon, alt)."""
    rows, base = _anchor(*anchor)
    p = ecef(lat, lon, alt)
    d = [p["x"] - base[0], p["y"] - base[1], p["z"] - base[2]]
    e, n, u = (sum((d[i] * row[i] for i in range(1, 3)), d[0] * row[0]) for row in rows)
    return F.struct(e.alias("east"), n.alias("north"), u.alias("up"))


def from_enu(east: Column, north: Column, up: Column, anchor: tuple[float, float, float]) -> Column:
    """Back to lat, lon, alt."""
    rows, base = _anchor(*anchor)
    x, y, z = (east * rows[0][i] + north * rows[1][i] + up * rows[2][i] + base[i] for i in range(3))
    return geodetic(x, y, z)


def zone_of_epsg(crs: Column) -> Column:
    """Zone number of EPSG:326xx or 327xx; anything else is an error."""
    zone = F.regexp_extract(crs, r"^EPSG:32[67](\d{2})$", 1)
    return F.when(zone.rlike("^(0[1-9]|[1-5][0-9]|60)$"), zone.cast("int")).otherwise(F.raise_error(F.concat(F.lit("not a UTM EPSG code: "), crs)).cast("int"))


def central_meridian(zone: Column) -> Column:
    return F.radians(zone * 6 - 183)


def _taup(tau: Column) -> Column:
    t1 = F.hypot(F.lit(1.0), tau)
    sig = F.sinh(E1 * F.atanh(E1 * tau / t1))
    return F.hypot(F.lit(1.0), sig) * tau - sig * t1


def utm(lat: Column, lon: Column, zone: int, north: bool = True) -> Column:
    """Easting and northing by the Kruger series."""
    d = lon - math.radians(zone * 6 - 183)
    taup = _taup(F.tan(lat))
    xi1, eta1 = F.atan2(taup, F.cos(d)), F.asinh(F.sin(d) / F.hypot(taup, F.cos(d)))
    xi, eta = xi1, eta1
    for i, a in enumerate(ALPHA, 1):
        xi = xi + a * F.sin(2 * i * xi1) * F.cosh(2 * i * eta1)
        eta = eta + a * F.cos(2 * i * xi1) * F.sinh(2 * i * eta1)
    return F.struct((FALSE_EAST + K0 * RECTIFYING * eta).alias("easting"), ((0.0 if north else FALSE_NORTH_SOUTH) + K0 * RECTIFYING * xi).alias("northing"))


def utm_inverse(easting: Column, northing: Column, zone: int, north: bool = True, rounds: int = 6) -> Column:
    """lat and lon; the latitude by fixed-point steps in a fold over a constant array."""
    x = (easting - FALSE_EAST) / (K0 * RECTIFYING)
    y = (northing - (0.0 if north else FALSE_NORTH_SOUTH)) / (K0 * RECTIFYING)
    xi, eta = y, x
    for i, b in enumerate(BETA, 1):
        xi = xi - b * F.sin(2 * i * y) * F.cosh(2 * i * x)
        eta = eta - b * F.cos(2 * i * y) * F.sinh(2 * i * x)
    taup = F.sin(xi) / F.hypot(F.sinh(eta), F.cos(xi))
    e2m = 1 - E2

    def step(tau: Column, _: Column) -> Column:
        t = _taup(tau)
        return tau + (taup - t) * (1 + e2m * tau * tau) / (e2m * F.hypot(F.lit(1.0), tau) * F.hypot(F.lit(1.0), t))

    tau = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), taup / e2m, step)
    return F.struct(F.atan(tau).alias("lat"), (math.radians(zone * 6 - 183) + F.atan2(F.sinh(eta), F.cos(xi))).alias("lon"))


def clamp_lat(lat: Column) -> Column:
    return F.greatest(F.lit(-MAX_LAT), F.least(F.lit(MAX_LAT), lat))


def tile_of(lon_deg: Column, lat_deg: Column, z: Column) -> Column:
    """Slippy tile x, y, clamped to the map."""
    n = F.pow(F.lit(2.0), z)
    x = ((lon_deg + 180) / 360 * n).cast("long")
    y = ((1 - F.asinh(F.tan(F.radians(clamp_lat(lat_deg)))) / math.pi) / 2 * n).cast("long")
    top = n.cast("long") - 1
    zero = F.lit(0).cast("long")
    return F.struct(F.greatest(zero, F.least(top, x)).alias("x"), F.greatest(zero, F.least(top, y)).alias("y"))


def tile_center(x: Column, y: Column, z: Column) -> Column:
    n = F.pow(F.lit(2.0), z)
    return F.struct(((x + 0.5) / n * 360 - 180).alias("lon"), F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * (y + 0.5) / n)))).alias("lat"))


def tile_bounds(x: Column, y: Column, z: Column) -> Column:
    """West, south, east, north in web-mercator metres."""
    size = F.lit(2 * HALF_CIRCLE) / F.pow(F.lit(2.0), z)
    west, north = x * size - HALF_CIRCLE, F.lit(HALF_CIRCLE) - y * size
    return F.struct(west.alias("west"), (north - size).alias("south"), (west + size).alias("east"), north.alias("north"))


def tile_corners(x: Column, y: Column, z: Column) -> Column:
    """NW, NE, SE, SW corners as an array of lon, lat."""
    b = tile_bounds(x, y, z)
    lon = lambda m: m / HALF_CIRCLE * 180
    lat = lambda m: F.degrees(F.atan(F.sinh(m / A)))
    return F.array(*(F.struct(lon(b[e]).alias("lon"), lat(b[n]).alias("lat")) for e, n in (("west", "north"), ("east", "north"), ("east", "south"), ("west", "south"))))


def ground_distance(lat_deg: Column, z: Column) -> Column:
    """Metres per pixel of a 256-pixel tile."""
    return F.lit(2 * HALF_CIRCLE / TILE_SIZE) / F.pow(F.lit(2.0), z) * F.cos(F.radians(clamp_lat(lat_deg)))


def quadkey(x: Column, y: Column, z: Column) -> Column:
    """Tile to quadkey; zoom 0 is the empty key."""
    bit = lambda v, i: F.pmod(F.floor(v / F.pow(F.lit(2.0), (i - 1).cast("double"))), F.lit(2))
    digits = F.transform(F.sequence(z, F.lit(1), F.lit(-1)), lambda i: (bit(x, i) + 2 * bit(y, i)).cast("string"))
    return F.when(z < 1, F.lit("")).otherwise(F.array_join(digits, ""))


def quadkey_tile(key: Column) -> Column:
    """Quadkey to x, y, z."""
    start = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))
    chars = F.filter(F.split(key, ""), lambda c: c != "")
    step = lambda a, c: F.struct((a["x"] * 2 + c.cast("long") % 2).alias("x"), (a["y"] * 2 + F.floor(c.cast("long") / 2)).alias("y"))
    xy = F.aggregate(chars, start, step)
    return F.struct(xy["x"].alias("x"), xy["y"].alias("y"), F.length(key).alias("z"))
