"""Sizes, crops, tiles, segments and projective maps as expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from framewright.functions.numeric import ratio


def fit_long_edge(w: Column, h: Column, edge: int) -> tuple[Column, Column]:
    """Width and height scaled so the long edge is at most ``edge``; never enlarged, 1 at least."""
    scale = F.least(F.lit(1.0), F.lit(float(edge)) / F.greatest(w, h))
    return tuple(F.greatest(F.lit(1), F.bround(x * scale).cast("int")) for x in (w, h))


def cover_crop(w: Column, h: Column, tw: Column, th: Column) -> dict[str, Column]:
    """Size after scaling to cover (tw, th), and the centred crop's corner."""
    scale = F.greatest(tw / w, th / h)
    nw, nh = F.greatest(tw, F.bround(w * scale).cast("int")), F.greatest(th, F.bround(h * scale).cast("int"))
    return {"scaled_w": nw, "scaled_h": nh, "left": F.floor((nw - tw) / 2).cast("int"), "top": F.floor((nh - th) / 2).cast("int")}


def size_change(w0: Column, h0: Column, w1: Column, h1: Column, slack: int = 2) -> dict[str, Column]:
    """Whether a size changed by more than the slack, and whether that was a crop (aspect too)."""
    moved = (F.abs(w0 - w1) > slack) | (F.abs(h0 - h1) > slack)
    skew = F.abs(w1 * h0 / w0 - h1)
    return {"resized": moved, "cropped": moved & (skew > slack)}


def tile_starts(length: Column, tile: int, overlap: int) -> Column:
    """Offsets of tiles along one axis: whole steps, the last one held back to end with the axis."""
    last = F.greatest(length - tile, F.lit(0))
    steps = F.sequence(F.lit(0), F.ceil(last / (tile - overlap)).cast("int"))
    return F.transform(steps, lambda k: F.least(k * (tile - overlap), last))


def feather(n: int, overlap: int, lead: Column, trail: Column) -> Column:
    """Weights of a tile's n positions: they rise as a squared sine over the distance to the nearest
    end that overlaps a neighbour (lead, trail), and are 1 beyond the overlap."""

    def one(i: Column) -> Column:
        far = F.lit(float(overlap))
        near = F.least(F.when(lead, i + 0.5).otherwise(far), F.when(trail, F.lit(n) - 0.5 - i).otherwise(far), far)
        return F.pow(F.sin(near * (math.pi / 2 / overlap)), 2)

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one)


def tiles(length: int, tile: int, overlap: int) -> list[tuple[int, int, np.ndarray]]:
    """(start, end, feather) of each tile along one axis: the same rules on arrays."""
    size, last = min(tile, length), max(length - tile, 0)
    starts = np.minimum(np.arange(math.ceil(last / (tile - overlap)) + 1) * (tile - overlap), last)
    at = np.arange(size) + 0.5
    out = []
    for start in starts.tolist():
        near = np.full(size, float(max(overlap, 1)))
        if start > 0:
            near = np.minimum(near, at)
        if start < last:
            near = np.minimum(near, size - at)
        out.append((start, start + size, np.sin(near * (math.pi / 2 / max(overlap, 1))) ** 2))
    return out


def segment_length(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    return F.sqrt(dx * dx + dy * dy)


def from_vertical(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Degrees between a segment and the vertical."""
    return F.degrees(F.atan2(F.abs(x2 - x1), F.abs(y2 - y1)))


def off_axis(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Degrees between a segment and the nearer axis."""
    up = from_vertical(x1, y1, x2, y2)
    return F.least(up, F.lit(90.0) - up)


def project(m: list[list[float]], x: Column, y: Column) -> tuple[Column, Column]:
    """A point under a 3x3 map; NULL where it goes to infinity."""
    a, b, w = (F.lit(r[0]) * x + F.lit(r[1]) * y + F.lit(r[2]) for r in m)
    return ratio(a, w), ratio(b, w)


def in_frame(x1: Column, y1: Column, x2: Column, y2: Column, w: Column, h: Column) -> Column:
    """Whether the midpoint lies in the frame, upper bounds excluded."""
    mx, my = (x1 + x2) / 2, (y1 + y2) / 2
    return (mx >= 0) & (mx < w) & (my >= 0) & (my < h)
