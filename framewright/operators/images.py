"""Operators on image rows: colour spaces, feature shares, smooth regions, distributed tiled fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions import geometry
from framewright.operators import kernels

#: Hue bands on 0..179, limits of saturation and value on 0..255.
BLUE, GREEN, WARM = (95, 130), (35, 85), (5, 25)
COLOURED_S, COLOURED_V, NEUTRAL_S, NEUTRAL_V, WHITE_V, CLIPPED, DARK = 40, 40, 30, 60, 200, 250, 10


# ------------------------------------------------------------------ colour

def to_hsv(rgb: np.ndarray) -> np.ndarray:
    """8-bit RGB to hue 0..179, saturation and value 0..255."""
    x = rgb.astype(np.float64)
    top, span = x.max(-1), np.ptp(x, -1)
    safe = np.where(span == 0, 1, span)
    r, g, b = ((top - x[..., i]) / safe for i in range(3))
    sector = np.select([x[..., 0] == top, x[..., 1] == top], [b - g, 2 + r - b], 4 + g - r)
    hue = np.where(span == 0, 0, sector * 30 % 180)
    sat = np.where(top == 0, 0, span * 255 / np.where(top == 0, 1, top))
    return np.stack([np.rint(hue) % 180, np.rint(sat), top], -1).astype(np.uint8)


def hsv(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """8-bit red, green and blue columns to hue 0..179, saturation and value 0..255 (int)."""
    top, span = F.greatest(r, g, b), F.greatest(r, g, b) - F.least(r, g, b)
    sector = F.when(r == top, (g - b) / span).when(g == top, F.lit(2) + (b - r) / span).otherwise(F.lit(4) + (r - g) / span)
    hue = F.when(span == 0, F.lit(0.0)).otherwise(F.pmod(sector * 30, F.lit(180.0)))
    sat = F.when(top == 0, F.lit(0.0)).otherwise(span * 255 / top)
    return {"h": (F.bround(hue).cast("int") % 180), "s": F.bround(sat).cast("int"), "v": top.cast("int")}


def masked_mean(values: str, mask: str) -> Column:
    """Mean of an array's values where the other array is not 0; NULL where the mask is empty."""
    inside = F.filter(F.arrays_zip(F.col(values).alias("v"), F.col(mask).alias("m")), lambda x: x["m"] != 0)
    total = F.aggregate(inside, F.lit(0.0), lambda s, x: s + x["v"].cast("double"))
    return F.when(F.size(inside) > 0, total / F.size(inside))


def to_lab(rgb: np.ndarray) -> np.ndarray:
    """Standard RGB on 0..1 to lightness 0..100 and a, b."""
    from framewright.functions.color import SRGB, STANDARD, matrix

    p, m = SRGB, np.array(matrix(STANDARD))
    linear = np.where(rgb <= p["decode_knee"], rgb / p["slope"], ((rgb + p["offset"]) / p["gain"]) ** p["power"])
    xyz = linear @ m.T / m.sum(1)
    f = np.where(xyz > (6 / 29) ** 3, np.cbrt(xyz), xyz / (3 * (6 / 29) ** 2) + 4 / 29)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)


def colour_shares(h: Column, s: Column, v: Column) -> dict[str, Column]:
    """Shares of pixel classes as aggregates over pixel rows."""
    coloured = (s >= COLOURED_S) & (v >= COLOURED_V)
    neutral = (s < NEUTRAL_S) & (v >= NEUTRAL_V)
    share = lambda c: F.avg(c.cast("int"))
    return {
        "blue": share(coloured & h.between(*BLUE)), "green": share(coloured & h.between(*GREEN)), "warm": share(coloured & h.between(*WARM)),
        "neutral": share(neutral), "white": share(neutral & (v >= WHITE_V)), "clipped": share(v >= CLIPPED), "dark": share(v <= DARK),
    }


# ------------------------------------------------------------------ surface fit

def surface_residual(df: DataFrame, keys: list[str], x: str, y: str, value: str) -> DataFrame:
    """keys, n, residual: the deviation of ``value`` from the quadratic surface in x and y that
    fits it best. The normal equations are sums, so rows are aggregated before any shuffle; one
    small system is solved for each key."""
    terms = [F.lit(1.0), F.col(x), F.col(y), F.col(x) * F.col(x), F.col(y) * F.col(y), F.col(x) * F.col(y)]
    pairs = [(i, j) for i in range(6) for j in range(i, 6)]
    sums = [F.sum(terms[i] * terms[j]) for i, j in pairs] + [F.sum(t * F.col(value)) for t in terms] + [F.sum(F.col(value) * F.col(value))]

    def solve(batch: pd.Series) -> pd.Series:
        out = []
        for s in batch:
            a = np.zeros((6, 6))
            for (i, j), z in zip(pairs, s):
                a[i, j] = a[j, i] = z
            b, square, n = np.array(s[21:27]), s[27], s[0]
            fit, *_ = np.linalg.lstsq(a, b, rcond=None)
            out.append(float(np.sqrt(max(0.0, (square - 2 * fit @ b + fit @ a @ fit) / n))))
        return pd.Series(out)

    residual = F.pandas_udf(solve, T.DoubleType())
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("_s")).select(*keys, "n", residual("_s").alias("residual"))


# ------------------------------------------------------------------ smooth region from the top

def top_region(gray: np.ndarray, step: float, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(span, bottom row by column or -1): pixels connected to the top edge by brightness steps of
    at most ``step``, within ``reach`` of the top row's 5th to 95th percentile; each column counts
    down to its first gap. Rows and columns are swept by turns until nothing is added."""
    low, high = np.percentile(gray[0], [5, 95])
    allowed = (gray >= low - reach) & (gray <= high + reach)
    down = (np.abs(np.diff(gray, axis=0)) <= step) & allowed[1:] & allowed[:-1]
    side = (np.abs(np.diff(gray, axis=1)) <= step) & allowed[:, 1:] & allowed[:, :-1]
    region = np.zeros(gray.shape, bool)
    region[0] = allowed[0]
    h, w = gray.shape
    while True:
        before = region.sum()
        for i in range(1, h):
            region[i] |= region[i - 1] & down[i - 1]
        for i in range(h - 2, -1, -1):
            region[i] |= region[i + 1] & down[i]
        for j in range(1, w):
            region[:, j] |= region[:, j - 1] & side[:, j - 1]
        for j in range(w - 2, -1, -1):
            region[:, j] |= region[:, j + 1] & side[:, j]
        if region.sum() == before:
            break
    depth = np.cumprod(region, 0).sum(0)
    return np.arange(h)[:, None] < depth[None, :], depth - 1


def coverage(df: DataFrame, key: str, mask: str, cutoff: float = 0.5) -> DataFrame:
    """Share of 8-bit mask values over the cutoff."""
    over = round(cutoff * 255)
    return df.select(key, (F.size(F.filter(mask, lambda x: x > over)) / F.size(mask)).alias("coverage"))


# ------------------------------------------------------------------ pixels of whole images, row by row

def composited(df: DataFrame, image: str = "image", fill: str = "fill", probability: str = "probability", cutoff: int = 127) -> DataFrame:
    """``df`` (h, w, flat 8-bit arrays: image and fill of h*w*3, probability of h*w) with image
    replaced where the probability exceeds the cutoff, over a soft edge."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf[image] = [
                kernels.replace_region(*(np.asarray(x, np.uint8).reshape(r_h, r_w, 3) for x in (a, b)), np.asarray(m, np.uint8).reshape(r_h, r_w), cutoff).ravel()
                for r_h, r_w, a, b, m in zip(pdf["h"], pdf["w"], pdf[image], pdf[fill], pdf[probability])
            ]
            yield pdf

    return df.mapInPandas(run, df.schema)


def equalized(df: DataFrame, values: str, clip: float = 1.5, grid: int = 8) -> DataFrame:
    """``df`` (h, w, a flat 8-bit array) with the array's contrast equalised within limits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf[values] = [
                kernels.equalize(np.asarray(x, np.uint8).reshape(h, w), clip, grid).ravel() for h, w, x in zip(pdf["h"], pdf["w"], pdf[values])
            ]
            yield pdf

    return df.mapInPandas(run, df.schema)


def predicted(df: DataFrame, predict, column: str = "prediction", kind: str = "array<double>") -> DataFrame:
    """``df`` with the column that ``predict`` makes of a batch: any function from a pandas table
    to one value a row, such as a model's. A batch is an Arrow batch; rows are independent."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{column: list(predict(pdf))})

    return df.mapInPandas(run, df.withColumn(column, F.lit(None).cast(kind)).schema)


def transformed(df: DataFrame, transform, image: str = "image", mask: str = "mask") -> DataFrame:
    """``df`` (h, w, flat arrays image of h*w*c and mask of h*w) with every pair replaced by what
    ``transform(image, mask)`` returns; both arrays keep the size of h and w."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pairs = [
                transform(np.asarray(x).reshape(h, w, -1), np.asarray(m).reshape(h, w)) for h, w, x, m in zip(pdf["h"], pdf["w"], pdf[image], pdf[mask])
            ]
            yield pdf.assign(**{image: [np.asarray(a).ravel() for a, _ in pairs], mask: [np.asarray(b).ravel() for _, b in pairs]})

    return df.mapInPandas(run, df.schema)


# ------------------------------------------------------------------ distributed fusion

def fused(frames: DataFrame, tile: int, overlap: int) -> DataFrame:
    """image, y, pixels (array<double>) from frames (image, k, h, w, pixels array<double> on 0..1).

    Frames are cut into tiles, the exposures of a tile meet and are fused, feathered rows of tiles
    that overlap are summed with their weights. No task holds a whole image of many exposures."""
    if tile and tile < 2 * overlap:
        raise ValueError("a tile must be at least two overlaps long")
    kind = frames.schema["image"].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                x = np.asarray(r.pixels, float).reshape(r.h, r.w)
                for y0, y1, _ in geometry.tiles(r.h, tile or r.h, overlap):
                    for x0, x1, _ in geometry.tiles(r.w, tile or r.w, overlap):
                        yield pd.DataFrame(
                            {"image": [r.image], "k": [r.k], "h": [r.h], "w": [r.w], "y0": [y0], "x0": [x0], "tw": [x1 - x0], "pixels": [x[y0:y1, x0:x1].ravel()]}
                        )

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        f = pdf.iloc[0]
        stack = np.stack([np.asarray(p, float) for p in pdf["pixels"]]).reshape(len(pdf), -1, f.tw)
        wy = next(w for a, _, w in geometry.tiles(f.h, tile or f.h, overlap) if a == f.y0)
        wx = next(w for a, _, w in geometry.tiles(f.w, tile or f.w, overlap) if a == f.x0)
        weight = np.outer(wy, wx)
        value = kernels.fuse(stack) * weight
        return pd.DataFrame(
            {"image": f.image, "w": f.w, "y": f.y0 + np.arange(len(wy)), "x0": f.x0, "value": list(value), "weight": list(weight)}
        )

    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        w = pdf["w"].iloc[0]
        total, weight = np.zeros(w), np.zeros(w)
        for x0, v, f in zip(pdf["x0"], pdf["value"], pdf["weight"]):
            total[x0 : x0 + len(v)] += v
            weight[x0 : x0 + len(v)] += f
        return pd.DataFrame({"image": [pdf["image"].iloc[0]], "y": [pdf["y"].iloc[0]], "pixels": [total / weight]})

    tiles = frames.mapInPandas(cut, f"image {kind}, k int, h int, w int, y0 int, x0 int, tw int, pixels array<double>")
    parts = tiles.groupBy("image", "y0", "x0").applyInPandas(join, f"image {kind}, w int, y int, x0 int, value array<double>, weight array<double>")
    return parts.groupBy("image", "y").applyInPandas(rows, f"image {kind}, y int, pixels array<double>")
