"""Numeric expressions. NULL stands for an undefined value everywhere; none of these makes NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom as double; a zero denominator gives NULL."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def ramp(x: Column, lo: float, hi: float) -> Column:
    """0 up to lo, 1 from hi on, a straight line between."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - F.lit(float(lo))) / F.lit(float(hi) - float(lo))))


def clamp(x: Column, lo, hi) -> Column:
    return F.greatest(num(lo), F.least(num(hi), x))


def snap(x: Column, step: float, lo: float = 0.0) -> Column:
    """Nearest multiple of step counted from lo, halves to even."""
    return F.lit(float(lo)) + F.bround((x - F.lit(float(lo))) / F.lit(float(step))) * F.lit(float(step))


def clamp_snap(x: Column, lo: float, hi: float, step: float) -> Column:
    """Clamp, then snap; in whole hundredths, as sliders store it."""
    return F.bround(snap(clamp(x, lo, hi), step, lo) * 100).cast("int")


def relative_exposure(shutter: Column, f_number: Column, iso: Column) -> Column:
    """shutter * iso / aperture^2, NULL if any is NULL."""
    return shutter * iso / (f_number * f_number)


def distinct_with_null(x: Column) -> Column:
    """Number of distinct values, NULL being one."""
    return F.count_distinct(x) + F.max(F.when(x.isNull(), 1).otherwise(0))


def ema_weight(k: Column, n: Column, least: int = 5, floor: float = 0.2) -> Column:
    """Weight of item k of n (from 1, oldest first) under the average whose step is
    max(1/k, floor): closed form of the fold, so sums may be partial and distributed."""
    keep = F.lit(1.0 - floor)
    early = F.pow(keep, (n - least).cast("double")) / F.lit(float(least))
    late = F.lit(floor) * F.pow(keep, (n - k).cast("double"))
    return F.when(n <= least, F.lit(1.0) / n).when(k <= least, early).otherwise(late)


def quantize_half_up(x: Column, top: int = 255) -> Column:
    return F.floor(x * F.lit(float(top)) + F.lit(0.5)).cast("int")


def quantize_down(x: Column, top: int = 255) -> Column:
    return clamp(x, 0, top).cast("int")
