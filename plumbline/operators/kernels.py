"""Dense numerical kernels: one group of rows at a time, grouped and shuffled by Spark.

Each group is one image pair, so its size is set by the sensor and not by the amount of
data; fits over runs and windows get only sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _starts(table: pa.Table, by: list[str]) -> np.ndarray:
    """The first row of each group of neighbouring rows with equal ``by``; nulls are equal."""
    new = np.zeros(len(table), bool)
    new[:1] = True
    for c in by:
        codes = pc.dictionary_encode(table[c].combine_chunks(), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with the first row of each, from batches of rows that ``by`` has in order: a task holds a batch and a group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        before = [held[-1].slice(len(held[-1]) - 1)] if held else []
        last = _starts(pa.Table.from_batches([*before, batch]), by)[-1] - len(before)
        if held and last < 0:
            held.append(batch)
            continue
        if held or last > 0:
            done = pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks()
            yield done, _starts(done, by)
        held = [batch.slice(last)]
    if held:
        done = pa.Table.from_batches(held).combine_chunks()
        yield done, _starts(done, by)


def image_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pixel tables (image, r, c, v) to a row per cell (image, r, c, a, b), an image's rows in one task and in order.

    Cells that are missing are 0.
    """
    both = a.select("image", "r", "c", F.col("v").alias("a"), F.lit(0.0).alias("b")).union(b.select("image", "r", "c", F.lit(0.0), "v"))
    cells = both.repartition("image").groupBy("image", "r", "c").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return cells.sortWithinPartitions("image")


def _images(table: pa.Table, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    r, c, *values = (table[n].to_numpy() for n in ("r", "c", "a", "b"))
    for lo, hi in zip(starts, [*starts[1:], len(table)], strict=True):
        y, x = r[lo:hi], c[lo:hi]
        a, b = np.zeros((2, y.max() + 1, x.max() + 1))
        a[y, x], b[y, x] = (v[lo:hi] for v in values)
        yield a, b


def _per_image(pairs: DataFrame, results: list[str], kernel: Callable[[np.ndarray, np.ndarray], tuple]) -> DataFrame:
    """What ``kernel`` makes of each image's two sides; a task holds a batch of cells and an image, however many images there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["image"]):
            made = zip(*(kernel(a, b) for a, b in _images(table, starts)), strict=True)
            yield pa.RecordBatch.from_arrays([table["image"].combine_chunks().take(pa.array(starts)).cast(pa.int64()), *(pa.array(v, pa.float64()) for v in made)], ["image", *results])

    return pairs.mapInArrow(run, "image long, " + ", ".join(f"{n} double" for n in results))


def hann2(h: int, w: int) -> np.ndarray:
    """Separable window that fades to 0 at the border."""
    return np.outer(np.hanning(h) if h > 1 else np.ones(1), np.hanning(w) if w > 1 else np.ones(1))


def orientation_field(img: np.ndarray, floor: float = 1e-6) -> np.ndarray:
    """Unit gradients as complex numbers at twice their angle, so that contrast may be reversed."""
    p = np.pad(img, 1, mode="edge")
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    g = gx + 1j * gy
    size = np.abs(g)
    return np.where(size > floor, (g / np.maximum(size, floor)) ** 2, 0)


def phase_correlation(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float, float]:
    """(shift in columns, in rows, peak, peak over the next lobe) that takes ``a`` onto ``b``.

    The peak is refined to a part of a pixel by a parabola through its neighbours.
    """
    fa, fb = np.fft.fft2(a), np.fft.fft2(b)
    cross = fb * np.conj(fa)
    surface = np.real(np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-12)))
    h, w = surface.shape
    r, c = np.unravel_index(int(np.argmax(surface)), surface.shape)
    peak = float(surface[r, c])

    def part(lo: float, mid: float, hi: float) -> float:
        bend = lo - 2 * mid + hi
        return 0.0 if bend >= 0 else float(np.clip(0.5 * (lo - hi) / bend, -0.5, 0.5))

    dr = r + part(surface[r - 1, c], peak, surface[(r + 1) % h, c])
    dc = c + part(surface[r, c - 1], peak, surface[r, (c + 1) % w])
    rr, cc = np.meshgrid(np.arange(h), np.arange(w), indexing="ij")
    ring = np.hypot((rr - r + h / 2) % h - h / 2, (cc - c + w / 2) % w - w / 2)
    other = surface[ring > max(1.5, min(h, w) / 16)]
    second = float(other.max()) if len(other) else 0.0
    return (dc + w / 2) % w - w / 2, (dr + h / 2) % h - h / 2, peak, peak / second if second > 0 else float("inf")


def bilinear_at(img: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values at fractional rows and columns; 0 outside."""
    h, w = img.shape
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    ok = (y >= 0) & (x >= 0) & (y <= h - 1) & (x <= w - 1)
    y0, x0 = np.clip(y0, 0, h - 2), np.clip(x0, 0, w - 2)
    fy, fx = y - y0, x - x0
    v = (1 - fy) * ((1 - fx) * img[y0, x0] + fx * img[y0, x0 + 1]) + fy * ((1 - fx) * img[y0 + 1, x0] + fx * img[y0 + 1, x0 + 1])
    return np.where(ok, v, 0.0)


def rotate_image(img: np.ndarray, radians: float) -> np.ndarray:
    """Rotate about the centre; 0 outside."""
    h, w = img.shape
    y, x = np.meshgrid(np.arange(h) - (h - 1) / 2, np.arange(w) - (w - 1) / 2, indexing="ij")
    c, s = np.cos(radians), np.sin(radians)
    return bilinear_at(img, s * x + c * y + (h - 1) / 2, c * x - s * y + (w - 1) / 2)


def log_polar(magnitude: np.ndarray, angles: int, radii: int) -> np.ndarray:
    """Half a turn of a centred spectrum, by angle and logarithm of the radius."""
    h, w = magnitude.shape
    top = min(h, w) / 2 - 1
    rho = np.exp(np.linspace(0, np.log(max(top, 2.0)), radii))
    th = np.linspace(0, np.pi, angles, endpoint=False)
    return bilinear_at(magnitude, h // 2 + np.outer(np.sin(th), rho), w // 2 + np.outer(np.cos(th), rho))


def rotation_and_scale(a: np.ndarray, b: np.ndarray, angles: int = 180, radii: int = 96) -> tuple[float, float]:
    """Rotation (radians, within a quarter turn either way) and scale of ``b`` against ``a``, from their spectra."""
    spectrum = lambda x: log_polar(np.log1p(np.abs(np.fft.fftshift(np.fft.fft2(x * hann2(*x.shape))))), angles, radii)
    la, lb = spectrum(a - a.mean()), spectrum(b - b.mean())
    shift_r, shift_a, _, _ = phase_correlation(la - la.mean(), lb - lb.mean())
    step = np.log(max(min(a.shape) / 2 - 1, 2.0)) / (radii - 1)
    return float(shift_a) * np.pi / angles, float(np.exp(-shift_r * step))


def match_images(pairs: DataFrame, sweep_deg: tuple[float, ...] = (0.0,), spectral: bool = False) -> DataFrame:
    """Per image pair: best rotation of the sweep, shift, peak, peak ratio and scale.

    With ``spectral``, the rotation that the images' spectra tell is tried as well, and their
    scale reported (1 without).  ``pairs`` is from ``image_pairs``; every image is registered on its own.
    """

    def kernel(a: np.ndarray, b: np.ndarray) -> tuple:
        w = hann2(*a.shape)
        target = orientation_field(b) * w
        angle, scale = rotation_and_scale(a, b) if spectral else (0.0, 1.0)
        angles = (*sweep_deg, -float(np.degrees(angle))) if spectral else sweep_deg
        tried = [(*phase_correlation(orientation_field(rotate_image(a, np.radians(d)) if d else a) * w, target), d) for d in angles]
        dx, dy, peak, ratio, d = max(tried, key=lambda t: t[2])
        return d, dx, dy, peak, min(ratio, 1e6), scale

    return _per_image(pairs, ["rotation_deg", "dx", "dy", "peak", "peak_ratio", "scale"], kernel)


def refine_shift(pairs: DataFrame, rounds: int = 15, tukey: float = 4.685) -> DataFrame:
    """Dense planar refinement of small motions (dx, dy, yaw): Gauss-Newton on intensities with Tukey weights."""

    return _per_image(pairs, ["dx", "dy", "yaw", "rms", "inlier_ratio"], lambda a, b: refine(a, b, rounds, tukey))


def refine(a: np.ndarray, b: np.ndarray, rounds: int, tukey: float) -> tuple[float, float, float, float, float]:
    """Motion (dx, dy, yaw) for which ``b`` at the moved place looks like ``a``."""
    h, w = a.shape
    y, x = (v.ravel() for v in np.meshgrid(np.arange(h) - (h - 1) / 2, np.arange(w) - (w - 1) / 2, indexing="ij"))
    gy, gx = np.gradient(b)
    motion, rms, share = np.zeros(3), float("nan"), 0.0
    for _ in range(rounds):
        c, s = np.cos(motion[2]), np.sin(motion[2])
        u, v = c * x - s * y + motion[0] + (w - 1) / 2, s * x + c * y + motion[1] + (h - 1) / 2
        ok = (u >= 0) & (v >= 0) & (u <= w - 1) & (v <= h - 1)
        if ok.sum() < 8:
            break
        r = bilinear_at(b, v, u)[ok] - a.ravel()[ok]
        r = r - np.median(r)
        scale = max(1.4826 * np.median(np.abs(r)), 1e-9) * tukey
        weight = np.where(np.abs(r) < scale, (1 - (r / scale) ** 2) ** 2, 0.0)
        jx, jy = bilinear_at(gx, v, u)[ok], bilinear_at(gy, v, u)[ok]
        j = np.stack([jx, jy, jx * (-s * x - c * y)[ok] + jy * (c * x - s * y)[ok]], axis=1)
        try:
            step = np.linalg.solve(j.T @ (j * weight[:, None]) + 1e-9 * np.eye(3), -j.T @ (weight * r))
        except np.linalg.LinAlgError:
            break
        motion = motion + step
        rms, share = float(np.sqrt(np.mean(r * r))), float((weight > 0).mean())
        if np.abs(step).max() < 1e-6:
            break
    return float(motion[0]), float(motion[1]), float(motion[2]), rms, share


def rigid3(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares rotation and translation of points ``a`` onto ``b``, never a reflection."""
    ca, cb = a.mean(axis=0), b.mean(axis=0)
    r = _rotation((a - ca).T @ (b - cb))
    return r, cb - r @ ca


def _rotation(cross: np.ndarray) -> np.ndarray:
    """The best rotation from the 3 x 3 cross-covariance, never a reflection."""
    u, _, vt = np.linalg.svd(cross)
    return vt.T @ np.diag([1.0, 1.0, np.sign(np.linalg.det(vt.T @ u.T)) or 1.0]) @ u.T


def fit_rigid3(pairs: DataFrame, by: list[str], least: int = 3) -> DataFrame:
    """Rotation (row-major) and translation per group of ``ax..az`` onto ``bx..bz``, with its residual.

    Sums by Spark, a 3 x 3 decomposition per group; the residual follows from the same sums.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", n long, rotation array<double>, translation array<double>, rms double"
    p, q = ("ax", "ay", "az"), ("bx", "by", "bz")
    sums = pairs.groupBy(*by).agg(
        F.count("*").alias("n"), F.array(*map(F.avg, p)).alias("__a"), F.array(*map(F.avg, q)).alias("__b"),
        F.array(*(F.covar_pop(i, j) for i in p for j in q)).alias("__cross"), sum((F.var_pop(c) for c in (*p[1:], *q)), F.var_pop(p[0])).alias("__size"),
    )

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rotation, translation, rms = [], [], []
            for a, b, cross, size in zip(pdf["__a"], pdf["__b"], pdf["__cross"], pdf["__size"], strict=True):
                cross = np.array(cross, float).reshape(3, 3)
                r = _rotation(cross)
                rotation.append(r.ravel().tolist())
                translation.append((np.array(b, float) - r @ np.array(a, float)).tolist())
                rms.append(float(np.sqrt(max(0.0, size - 2 * np.sum(r * cross.T)))))
            yield pdf[[*by, "n"]].assign(rotation=rotation, translation=translation, rms=rms)

    return sums.filter(F.col("n") >= least).mapInPandas(kernel, schema)


def principal_axes(points: DataFrame, by: list[str]) -> DataFrame:
    """Standard deviations along the principal axes and the least one's direction; sums by Spark, 3 x 3 eigenvectors per group."""
    axes = ("x", "y", "z")
    sums = points.groupBy(*by).agg(F.count("*").alias("n"), *(F.covar_pop(p, q).alias(f"{p}{q}") for i, p in enumerate(axes) for q in axes[i:]))
    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", n long, sigma array<double>, up array<double>"

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sigma, up = [], []
            for _, r in pdf.iterrows():
                m = np.array([[r["xx"], r["xy"], r["xz"]], [r["xy"], r["yy"], r["yz"]], [r["xz"], r["yz"], r["zz"]]], float)
                val, vec = np.linalg.eigh(m)
                sigma.append(np.sqrt(np.clip(val[::-1], 0, None)).tolist())
                axis = vec[:, 0]
                up.append((axis * (np.sign(axis[np.argmax(np.abs(axis))]) or 1.0)).tolist())
            yield pdf[[*by, "n"]].assign(sigma=sigma, up=up)

    return sums.mapInPandas(kernel, schema)
