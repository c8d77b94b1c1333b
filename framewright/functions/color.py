"""Transfer curves, tone curves and colour-matrix expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framewright.functions.numeric import clamp

#: The standard RGB curve, the wide-gamut gamma, the reference white (x, y).
SRGB = {"encode_knee": 0.0031308, "decode_knee": 0.04045, "slope": 12.92, "gain": 1.055, "offset": 0.055, "power": 2.4}
WIDE_GAMMA = 563 / 256
WHITE = (0.3127, 0.3290)
#: Primaries (x, y) of the standard and the wide space.
STANDARD = ((0.64, 0.33), (0.30, 0.60), (0.15, 0.06))
WIDE = ((0.64, 0.33), (0.21, 0.71), (0.15, 0.06))


def encode(x: Column) -> Column:
    """Linear light to standard signal."""
    p = SRGB
    return F.when(x <= p["encode_knee"], x * p["slope"]).otherwise(
        F.lit(p["gain"]) * F.pow(x, F.lit(1 / p["power"])) - p["offset"]
    )


def decode(x: Column) -> Column:
    """Standard signal to linear light."""
    p = SRGB
    return F.when(x <= p["decode_knee"], x / p["slope"]).otherwise(
        F.pow((x + p["offset"]) / p["gain"], F.lit(p["power"]))
    )


def wide_decode(x: Column) -> Column:
    return F.pow(x, F.lit(WIDE_GAMMA))


def matrix(primaries, white=WHITE) -> list[list[float]]:
    """Linear RGB to XYZ for three primaries and a white point."""
    import numpy as np

    p = np.array([[x / y, 1.0, (1 - x - y) / y] for x, y in primaries]).T
    w = np.array([white[0] / white[1], 1.0, (1 - white[0] - white[1]) / white[1]])
    return (p * np.linalg.solve(p, w)).tolist()


def wide_to_standard() -> list[list[float]]:
    import numpy as np

    return (np.linalg.inv(np.array(matrix(STANDARD))) @ np.array(matrix(WIDE))).tolist()


def apply_matrix(m: list[list[float]], rgb: tuple[Column, Column, Column]) -> list[Column]:
    """Three dot products."""
    return [sum((F.lit(row[k]) * rgb[k] for k in range(3)), F.lit(0.0)) for row in m]


def tone_gamma(old: Column, new: Column) -> Column:
    """The exponent that moves lightness old to new on 0..100, both clamped to 1..99."""
    return F.ln(clamp(new, 1, 99) / 100) / F.ln(clamp(old, 1, 99) / 100)


def tone_curve(x: Column, gamma: Column) -> Column:
    """Power curve on 0..100; exponents within 1e-6 of 1 change nothing."""
    return F.when(F.abs(gamma - 1) < 1e-6, x).otherwise(F.pow(x / 100, gamma) * 100)


def edge_taper(lightness: Column, reach: float = 10.0) -> Column:
    """Weight of a colour shift: falls to 0 at black and white."""
    return clamp(F.least(lightness, F.lit(100.0) - lightness) / reach, 0, 1)
