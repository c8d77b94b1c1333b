"""Dense-array kernels on numpy behind Arrow, and the native expressions around them."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions import geometry

#: The straightening gate.
LINES, LARGEST, SMALLEST, KEPT = 4, 30.0, 0.1, 0.60
#: Fixed value: boundary width as a share of the diagonal.
BOUNDARY = 0.02
#: Widest boundary that is an expression.
NARROW = 2


# ------------------------------------------------------------------ native

def correction_gate(lines: Column, inliers: Column, degrees: Column, behind: Column, crop: Column, kept: Column) -> Column:
    """Outcome of a correction: the first reason against it, or applied."""
    return (
        F.when(lines < LINES, "few_lines")
        .when(inliers < LINES, "few_inliers")
        .when(degrees > LARGEST, "too_large")
        .when(degrees < SMALLEST, "vertical")
        .when(behind, "behind_camera")
        .when(~crop, "no_crop")
        .when(kept < KEPT, "small_crop")
        .otherwise("applied")
    )


def best_quality(sizes: DataFrame, key: str, budget: int, floor: int) -> DataFrame:
    """key, quality, fits from rows (key, quality, size)."""
    fits = F.col("size") <= budget
    return sizes.groupBy(key).agg(
        F.coalesce(F.max(F.when(fits, F.col("quality"))), F.lit(floor)).cast("long").alias("quality"), F.bool_or(fits).alias("fits")
    )


def blend(a: Column, b: Column, alpha: float, scale: float = 1.0, shift: float = 0.0) -> Column:
    """Element-wise mix of two arrays, rounded half to even."""
    return F.zip_with(
        a, b,
        lambda x, y: F.rint(F.lit(shift) + F.lit(scale) * (F.lit(alpha) * x.cast("double") + F.lit(1 - alpha) * y.cast("double"))).cast("int"),
    )


# ------------------------------------------------------------------ masks

def boundary_width(h: int, w: int, share: float = BOUNDARY) -> int:
    return max(1, round(share * math.hypot(h, w)))


def inner_boundary(mask: np.ndarray, d: int) -> np.ndarray:
    """Mask pixels within d steps (diagonals count one) of the background or the frame: those not
    at the centre of a full square of side 2d + 1, found from the mask's summed-area table."""
    h, w = mask.shape
    padded = np.zeros((h + 2 * d + 1, w + 2 * d + 1), np.int64)
    padded[d + 1 : d + 1 + h, d + 1 : d + 1 + w] = mask
    s = padded.cumsum(0).cumsum(1)
    side = 2 * d + 1
    full = s[side:, side:] - s[:-side, side:] - s[side:, :-side] + s[:-side, :-side]
    return mask & (full < side * side)


def boundary_flags(mask: Column, h: int, w: int, d: int) -> Column:
    """The same as an expression over a flat mask of 0 and 1: a pixel stays if the pixels d to
    either side are in the mask, first along rows, then along columns."""

    def eroded(inner: Column, step: int, place, size: int) -> Column:
        def stays(v: Column, i: Column) -> Column:
            near = [(place(i) + k >= 0) & (place(i) + k < size) & (F.get(inner, i + k * step) != 0) for k in range(-d, d + 1) if k]
            return F.when(reduce(Column.__and__, near, v != 0), 1).otherwise(0)

        return F.transform(inner, stays)

    bound = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)  # noqa: E731  computed once
    return bound(
        mask,
        lambda m: bound(
            eroded(m, 1, lambda i: i % w, w),
            lambda r: F.zip_with(m, eroded(r, w, lambda i: F.floor(i / w), h), lambda a, b: (a != 0) & (b == 0)),
        ),
    )


def boundary_counts(df: DataFrame, keys: list[str], truth: str, guess: str, h: int, w: int, share: float = BOUNDARY) -> DataFrame:
    """Pooled intersection and union of the masks' boundaries, sums of two numbers for each row. Narrow
    boundaries are expressions; wide ones, with many neighbours, a scalar Arrow function."""
    d = boundary_width(h, w, share)
    if d <= NARROW:
        edges = df.withColumns({"_p": boundary_flags(F.col(truth), h, w, d), "_q": boundary_flags(F.col(guess), h, w, d)})
        count = lambda f: F.sum(F.size(F.filter(F.zip_with("_p", "_q", f), lambda x: x)))
        return edges.groupBy(*keys).agg(
            count(lambda a, b: a & b).alias("inter"), count(lambda a, b: a | b).alias("union"), F.count(F.lit(1)).alias("images")
        )

    @F.pandas_udf("inter long, union long")
    def both(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b):
            p, q = (inner_boundary(np.asarray(m).reshape(h, w).astype(bool), d) for m in (x, y))
            rows.append((int((p & q).sum()), int((p | q).sum())))
        return pd.DataFrame(rows, columns=["inter", "union"])

    return (
        df.withColumn("_c", both(truth, guess))
        .groupBy(*keys)
        .agg(F.sum("_c.inter").alias("inter"), F.sum("_c.union").alias("union"), F.count(F.lit(1)).alias("images"))
    )


# ------------------------------------------------------------------ vanishing points

def vanishing_point(segments: np.ndarray, draws: int = 500, near: float = 1.5, seed: int = 0) -> tuple[np.ndarray | None, np.ndarray]:
    """(homogeneous point, inliers) where most length of the segments (n, 4) meets. Pairs are drawn
    by length all at once, their meeting points tested against all segments in one array, and the
    best set refitted twice by the smallest eigenvector of its weighted line scatter."""
    n = len(segments)
    none = np.zeros(n, bool)
    if n < 2:
        return None, none
    a, b = segments[:, :2], segments[:, 2:]
    lines = np.stack([a[:, 1] - b[:, 1], b[:, 0] - a[:, 0], a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]], 1)
    size = np.hypot(lines[:, 0], lines[:, 1])
    lines = lines / np.maximum(size, 1e-12)[:, None]
    middle, along = (a + b) / 2, (b - a) / np.maximum(size, 1e-12)[:, None]
    rng = np.random.default_rng(seed)
    first = rng.choice(n, draws, p=size / size.sum())
    second = (first + rng.integers(1, n, draws)) % n
    points = np.cross(lines[first], lines[second])

    def close(p: np.ndarray) -> np.ndarray:
        toward = p[:, None, :2] - middle[None] * p[:, None, 2:]
        cross = np.abs(toward[..., 0] * along[None, :, 1] - toward[..., 1] * along[None, :, 0])
        dot = np.abs((toward * along[None]).sum(-1))
        return np.degrees(np.arctan2(cross, dot)) < near

    found = close(points)
    score = (found * size).sum(1)
    inside = found[int(score.argmax())]
    point = None
    for _ in range(2):
        if inside.sum() < 2:
            return None, none
        use = lines[inside] * np.sqrt(size[inside])[:, None]
        point = np.linalg.eigh(use.T @ use)[1][:, 0]
        inside = close(point[None])[0]
    return point, inside


def vanishing_points(segments: DataFrame, key: str, near: float = 1.5) -> DataFrame:
    """key, lines, inliers, x, y, w from rows (key, x1, y1, x2, y2): one image at a time."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x1", "y1", "x2", "y2"])
        point, inside = vanishing_point(pdf[["x1", "y1", "x2", "y2"]].to_numpy(float), near=near)
        x, y, w = (None, None, None) if point is None else point.tolist()
        return pd.DataFrame({key: [pdf[key].iloc[0]], "lines": [len(pdf)], "inliers": [int(inside.sum())], "x": [x], "y": [y], "w": [w]})

    kind = segments.schema[key].dataType.simpleString()
    return segments.groupBy(key).applyInPandas(one, f"{key} {kind}, lines long, inliers long, x double, y double, w double")


# ------------------------------------------------------------------ tiled fusion

def exposure_weight(x: np.ndarray, sigma: float = 0.2) -> np.ndarray:
    """How well exposed values of 0..1 are."""
    return np.exp(-((x - 0.5) ** 2) / (2 * sigma * sigma)) + 1e-6


def fuse(stack: np.ndarray) -> np.ndarray:
    """Exposures (k, h, w) as one, by normalised weights of each."""
    w = exposure_weight(stack)
    return (stack * w).sum(0) / w.sum(0)


def fuse_tiled(stack: np.ndarray, tile: int, overlap: int) -> np.ndarray:
    """The same by overlapping tiles with feathered weights; one tile is the whole exactly."""
    _, h, w = stack.shape
    total, weight = np.zeros((h, w)), np.zeros((h, w))
    for y0, y1, wy in geometry.tiles(h, tile, overlap):
        for x0, x1, wx in geometry.tiles(w, tile, overlap):
            f = np.outer(wy, wx)
            total[y0:y1, x0:x1] += fuse(stack[:, y0:y1, x0:x1]) * f
            weight[y0:y1, x0:x1] += f
    return total / weight


# ------------------------------------------------------------------ straightening geometry

def rotation_to_vertical(point: np.ndarray, focal: float) -> tuple[np.ndarray, float]:
    """(rotation, degrees): the least rotation that turns the direction to a vanishing point, in
    pixels from the centre, onto the y axis. Two mirrors in a row turn by twice the angle between
    them: the first stands across the direction, the second across the half-way direction."""
    seen = np.asarray(point, float) / (focal, focal, 1.0)
    seen /= np.copysign(np.linalg.norm(seen), seen[1])  # a point and its opposite are one; the nearer counts
    up = np.eye(3)[1]
    half = (seen + up) / np.linalg.norm(seen + up)
    mirror = lambda across: np.eye(3) - 2 * np.outer(across, across)
    return mirror(half) @ mirror(seen), 2 * math.degrees(math.asin(min(1.0, np.linalg.norm(seen - up) / 2)))


def inscribed_rectangle(corners: np.ndarray, aspect: float) -> tuple[float, float, float] | None:
    """(centre x, centre y, half width) of the largest upright rectangle of an aspect ratio inside a
    convex polygon of any number of corners. Each edge is a linear bound on centre and half width;
    the best of this linear programme is a point where the bounds of three edges meet, and all such
    points are solved at once."""
    along = np.roll(corners, -1, 0) - corners
    outward = np.column_stack([along[:, 1], -along[:, 0]]) / np.hypot(*along.T)[:, None]
    outward *= np.sign(((corners - corners.mean(0)) * outward).sum(1))[:, None]
    bounds = np.column_stack([outward, np.abs(outward) @ (1.0, 1.0 / aspect)])
    limits = (outward * corners).sum(1)
    threes = np.array(list(combinations(range(len(corners)), 3)))
    threes = threes[np.abs(np.linalg.det(bounds[threes])) > 1e-12]
    meet = np.linalg.solve(bounds[threes], limits[threes][..., None])[..., 0]
    meet = meet[(meet @ bounds.T <= limits + 1e-6 * (1 + np.abs(limits))).all(1) & (meet[:, 2] > 0)]
    return tuple(meet[meet[:, 2].argmax()].tolist()) if len(meet) else None


# ------------------------------------------------------------------ contrast and compositing

def box(x: np.ndarray, r: int, axis: int) -> np.ndarray:
    """Running mean over 2r + 1 values, edges repeated."""
    pad = [(0, 0)] * x.ndim
    pad[axis] = (r + 1, r)
    s = np.cumsum(np.pad(x.astype(float), pad, mode="edge"), axis)
    n = x.shape[axis]
    take = lambda a: np.take(s, np.arange(a, a + n), axis)
    return (take(2 * r + 1) - take(0)) / (2 * r + 1)


def soften(x: np.ndarray, sigma: float) -> np.ndarray:
    """Close to a Gaussian blur: three running means in each direction."""
    r = max(1, round((math.sqrt(4 * sigma * sigma + 1) - 1) / 2))
    for _ in range(3):
        x = box(box(x, r, 0), r, 1)
    return x


def replace_region(image: np.ndarray, fill: np.ndarray, probability: np.ndarray, cutoff: int = 127) -> np.ndarray:
    """8-bit image with ``fill`` where probability exceeds the cutoff, over a soft edge whose width
    follows the size."""
    if image.dtype != np.uint8 or fill.shape != image.shape or probability.shape != image.shape[:2]:
        raise ValueError("expected two 8-bit images of one size and a mask of it")
    alpha = (probability > cutoff).astype(float)
    if 0 < alpha.mean() < 1:
        alpha = soften(alpha, max(1.0, min(alpha.shape) / 500))
    a = alpha[..., None]
    return np.rint(image * (1 - a) + fill * a).astype(np.uint8)


def equalize(x: np.ndarray, clip: float = 1.5, grid: int = 8) -> np.ndarray:
    """Contrast-limited equalisation of 8-bit values: one curve for each cell of a grid from its
    histogram, counts over ``clip`` times the mean spread evenly, curves mixed between the centres."""
    h, w = x.shape
    rows, cols = np.minimum(np.arange(h) * grid // h, grid - 1), np.minimum(np.arange(w) * grid // w, grid - 1)
    cell = rows[:, None] * grid + cols[None, :]
    hist = np.zeros((grid * grid, 256))
    np.add.at(hist, (cell, x), 1)
    n = np.maximum(hist.sum(1, keepdims=True), 1)
    most = clip * n / 256
    over = np.maximum(hist - most, 0).sum(1, keepdims=True)
    curve = np.cumsum(np.minimum(hist, most) + over / 256, 1) / n * 255
    at = lambda size: np.clip((np.arange(size) + 0.5) * grid / size - 0.5, 0, grid - 1)
    y, z = at(h), at(w)
    y0, z0 = np.floor(y).astype(int), np.floor(z).astype(int)
    y1, z1 = np.minimum(y0 + 1, grid - 1), np.minimum(z0 + 1, grid - 1)
    fy, fz = (y - y0)[:, None], (z - z0)[None, :]
    pick = lambda a, b: curve[a[:, None] * grid + b[None, :], x]
    mixed = (1 - fy) * ((1 - fz) * pick(y0, z0) + fz * pick(y0, z1)) + fy * ((1 - fz) * pick(y1, z0) + fz * pick(y1, z1))
    return np.rint(mixed).astype(np.uint8)
