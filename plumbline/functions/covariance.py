"""3x3 covariances (east, north, yaw) held as six columns ee, en, ey, nn, ny, yy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = ("ee", "en", "ey", "nn", "ny", "yy")
#: Chi-squared, three degrees of freedom, 99 %.
GATE_99 = 11.34


def columns(prefix: str = "cov_") -> dict[str, Column]:
    """The six columns by name."""
    return {k: F.col(prefix + k) for k in UPPER}


def matrix(c: dict[str, Column]) -> Column:
    """Symmetric matrix as an array of rows."""
    return F.array(F.array(c["ee"], c["en"], c["ey"]), F.array(c["en"], c["nn"], c["ny"]), F.array(c["ey"], c["ny"], c["yy"]))


def minors(c: dict[str, Column]) -> tuple[Column, Column, Column]:
    """Leading principal minors."""
    d2 = c["ee"] * c["nn"] - c["en"] * c["en"]
    d3 = c["ee"] * (c["nn"] * c["yy"] - c["ny"] * c["ny"]) - c["en"] * (c["en"] * c["yy"] - c["ny"] * c["ey"]) + c["ey"] * (c["en"] * c["ny"] - c["nn"] * c["ey"])
    return c["ee"], d2, d3


def is_valid(c: dict[str, Column], eps: float = 1e-12) -> Column:
    """Finite and positive definite (Sylvester)."""
    finite = [F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)) for v in c.values()]
    return F.coalesce(F.expr("true") & finite[0] & finite[1] & finite[2] & finite[3] & finite[4] & finite[5] & (minors(c)[0] > eps) & (minors(c)[1] > eps) & (minors(c)[2] > eps), F.lit(False))


def mahalanobis2(de: Column, dn: Column, c: dict[str, Column]) -> Column:
    """Planar squared distance; null where the block is singular."""
    det = minors(c)[1]
    return F.try_divide(c["nn"] * de * de - 2 * c["en"] * de * dn + c["ee"] * dn * dn, det)


def mahalanobis3(de: Column, dn: Column, dy: Column, c: dict[str, Column]) -> Column:
    """Squared distance in all three; null where singular."""
    a, b, d = c["nn"] * c["yy"] - c["ny"] * c["ny"], c["ee"] * c["yy"] - c["ey"] * c["ey"], c["ee"] * c["nn"] - c["en"] * c["en"]
    ab, ac, bc = c["ey"] * c["ny"] - c["en"] * c["yy"], c["en"] * c["ny"] - c["ey"] * c["nn"], c["en"] * c["ey"] - c["ee"] * c["ny"]
    return F.try_divide(a * de * de + b * dn * dn + d * dy * dy + 2 * (ab * de * dn + ac * de * dy + bc * dn * dy), minors(c)[2])


def sigma_position(c: dict[str, Column]) -> Column:
    """Horizontal sigma."""
    return F.sqrt(c["ee"] + c["nn"])


def add_systematic(c: dict[str, Column], sigma_m: float) -> dict[str, Column]:
    """Add a map bias to the position block."""
    return c | {"ee": c["ee"] + sigma_m**2, "nn": c["nn"] + sigma_m**2}


def floored(c: dict[str, Column], sigma_pos_m: float, sigma_yaw: float) -> dict[str, Column]:
    """No variance below its floor."""
    p, y = F.lit(sigma_pos_m**2), F.lit(sigma_yaw**2)
    return c | {"ee": F.greatest(c["ee"], p), "nn": F.greatest(c["nn"], p), "yy": F.greatest(c["yy"], y)}


def prior_radius(c: dict[str, Column], margin: float, least: float, most: float, k: float = 3.0) -> Column:
    """Search radius around a prior, clamped."""
    return F.least(F.greatest(k * sigma_position(c) + margin, F.lit(least)), F.lit(most))
