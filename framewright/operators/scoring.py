"""Scores, decisions and labels from a flat feature record."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions.numeric import ramp

#: The feature record in its own order and names (brightness, colour, top region, edges).
FEATURES = (
    "lum_mean", "lum_std", "lum_p5", "lum_p50", "lum_p95", "clipped_frac", "dark_frac", "top_bottom_ratio",
    "sat_mean", "sat_std", "blue_frac", "green_frac", "warm_frac", "neutral_frac", "white_frac", "green_bottom_frac",
    "sky_area_frac", "sky_top_coverage", "sky_edge_density", "sky_residual", "sky_below_ratio", "sky_colour_support",
    "edge_density", "line_length_norm", "axis_line_frac", "fine_texture",
)
#: Thresholds of the decision and of the room choice.
THRESHOLDS = {
    "exterior": 0.55, "interior": 0.50, "margin": 0.20, "span": 0.70, "unsure": 0.2,
    "temperature": 0.1, "room": 0.55, "room_margin": 0.08,
}
UP, DOWN = "up", "down"
#: What makes each score. A factor (feature, low, high, direction) is a ramp between two
#: limits, or the feature itself without them; a term is a weight times its factors; a score sums terms.
TOP_REGION = (("sky_area_frac", 0.05, 0.25, UP), ("sky_top_coverage", 0.30, 0.80, UP))
BRIGHTER = ("sky_below_ratio", 1.0, 1.15, UP)
EVIDENCE = {
    "exterior": (
        (0.80 * 0.4, (*TOP_REGION, BRIGHTER)),
        (0.80 * 0.6 * 0.55, (*TOP_REGION, BRIGHTER, ("sky_edge_density", 0.01, 0.06, DOWN))),
        (0.80 * 0.6 * 0.45, (*TOP_REGION, BRIGHTER, ("sky_residual", 0.04, 0.15, DOWN))),
        (0.10, (*TOP_REGION, ("sky_colour_support", None, None, UP))),
        (0.10, (("green_bottom_frac", 0.05, 0.30, UP),)),
    ),
    "interior": (
        (0.70, (*TOP_REGION, ("sky_below_ratio", 0.85, 1.05, DOWN))),
        (0.30, (("axis_line_frac", 0.60, 0.90, UP), ("line_length_norm", 1.0, 3.0, UP))),
    ),
}
ROOMS = {
    "bathroom": (
        (0.40, (("white_frac", 0.15, 0.45, UP),)),
        (0.25, (("sat_mean", 0.10, 0.30, DOWN),)),
        (0.20, (("neutral_frac", 0.30, 0.70, UP),)),
        (0.15, (("fine_texture", 0.02, 0.06, UP),)),
    ),
    "kitchen": (
        (0.35, (("edge_density", 0.05, 0.14, UP),)),
        (0.30, (("line_length_norm", 0.5, 3.0, UP),)),
        (0.20, (("axis_line_frac", 0.50, 0.85, UP),)),
        (0.15, (("neutral_frac", 0.20, 0.50, UP),)),
    ),
    "bedroom-living": (
        (0.35, (("warm_frac", 0.10, 0.40, UP),)),
        (0.30, (("edge_density", 0.04, 0.12, DOWN),)),
        (0.20, (("sat_mean", 0.12, 0.30, UP),)),
        (0.15, (("white_frac", 0.10, 0.35, DOWN),)),
    ),
}


def record_type() -> T.StructType:
    return T.StructType([T.StructField(f, T.DoubleType()) for f in FEATURES])


def factor(feature: str, low: float | None, high: float | None, direction: str) -> Column:
    value = F.col(feature) if low is None else ramp(F.col(feature), low, high)
    return value if direction == UP else F.lit(1.0) - value


def score(terms: tuple) -> Column:
    """The sum of a score's terms over columns of the features' names."""
    each = [F.lit(float(weight)) * reduce(Column.__mul__, [factor(*f) for f in factors]) for weight, factors in terms]
    return reduce(Column.__add__, each)


def decide(e: Column, i: Column, t: dict = THRESHOLDS) -> tuple[Column, Column]:
    """(call, confidence) from the two evidences."""
    sure = lambda d: F.lit(0.5) + F.lit(0.5) * ramp(d, t["margin"], t["span"])
    out = (e >= t["exterior"]) & (e - i >= t["margin"])
    within = (i >= t["interior"]) & (i - e >= t["margin"])
    call = F.when(out, "exterior").when(within, "interior").otherwise("unsure")
    return call, F.when(out, sure(e - i)).when(within, sure(i - e)).otherwise(F.lit(t["unsure"]))


def choose_room(df: DataFrame, t: dict = THRESHOLDS) -> DataFrame:
    """``df`` (with columns of the features' names) with room, probability, lead."""
    scores = {room: score(terms) for room, terms in ROOMS.items()}
    top = F.greatest(*scores.values())
    weights = {r: F.exp((s - top) / t["temperature"]) for r, s in scores.items()}
    total = sum(weights.values(), F.lit(0.0))
    best = F.sort_array(
        F.array(*[F.struct((w / total).alias("p"), F.lit(r).alias("room")) for r, w in weights.items()]), asc=False
    )
    first, second = best[0], best[1]
    lead = first["p"] - second["p"]
    ok = (first["p"] >= t["room"]) & (lead >= t["room_margin"])
    return df.withColumns(
        {
            "room": F.when(ok, first["room"]).otherwise("other"),
            "probability": F.when(ok, first["p"]).otherwise(F.lit(t["unsure"])),
            "lead": lead,
        }
    )


def classify(df: DataFrame, t: dict = THRESHOLDS) -> DataFrame:
    """``df`` with exterior, interior, call, confidence."""
    scored = df.withColumns({name: score(terms) for name, terms in EVIDENCE.items()})
    call, sure = decide(F.col("exterior"), F.col("interior"), t)
    return scored.withColumns({"call": call, "confidence": sure})


def logged(df: DataFrame, t: dict = THRESHOLDS) -> DataFrame:
    """The record as JSON, with the thresholds it was scored under."""
    snapshot = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in t.items()]))
    return df.withColumns({"features": F.to_json(F.struct(*FEATURES)), "thresholds": snapshot})


def rescore(log: DataFrame, t: dict = THRESHOLDS) -> DataFrame:
    """Score the JSON records of a log anew, under other thresholds."""
    read = log.withColumn("_f", F.from_json("features", record_type()))
    flat = read.withColumns({f: F.col(f"_f.{f}") for f in FEATURES})
    return classify(flat, t).drop("_f", *FEATURES)
