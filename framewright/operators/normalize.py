"""Normalising groups toward robust targets under cap rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions import color
from framewright.functions.numeric import clamp

#: Strength, caps on lightness and colour shifts, smallest group.
STRENGTH, CAP_L, CAP_AB, GROUP = 0.7, 12.0, 8.0, 3
#: Radius and rounds of the trimmed centre, least share of neutral values.
RADIUS, ROUNDS, NEUTRAL = 12.0, 3, 0.05
#: Lightness that is measured, least share of pixels in it.
VALID_L, VALID = (3.0, 97.0), 0.10


def targets(df: DataFrame, group: str, least: int = GROUP) -> DataFrame:
    """Medians of l, a, b by group (missing values left out); NULL for small groups."""
    n = F.count(F.lit(1))
    mid = lambda c: F.when(n >= least, F.median(c)).alias(f"target_{c}")
    return df.groupBy(group).agg(n.alias("members"), mid("l"), mid("a"), mid("b"))


def sync(df: DataFrame, group: str, strength: float = STRENGTH, cap_l: float = CAP_L, cap_ab: float = CAP_AB) -> DataFrame:
    """Each row's needed and applied shifts, status and reason codes."""
    if not 0 <= strength <= 1:
        raise ValueError("strength must lie in [0, 1]")
    joined = df.join(targets(df, group), group)
    da, db = F.col("target_a") - F.col("a"), F.col("target_b") - F.col("b")
    need_l, need_ab = F.col("target_l") - F.col("l"), F.sqrt(da * da + db * db)
    over_l, over_ab = F.abs(need_l) > cap_l, F.coalesce(need_ab > cap_ab, F.lit(False))
    measured = need_l.isNotNull()
    ok = measured & ~over_l & ~over_ab
    reason = (
        F.when(F.col("target_l").isNull(), "no_target")
        .when(F.col("l").isNull(), "unmeasured")
        .when(~ok, F.concat_ws("+", F.when(over_l, "dl"), F.when(over_ab, "dab")))
        .when(need_ab.isNull(), "brightness_only")
        .otherwise("")
    )
    applied = lambda x: F.when(ok, F.lit(strength) * x)
    return joined.select(
        *df.columns,
        F.when(ok, "corrected").otherwise("skipped").alias("status"),
        reason.alias("reason"),
        need_l.alias("needed_dl"),
        F.when(measured, need_ab).alias("needed_dab"),
        applied(need_l).alias("applied_dl"),
        applied(F.when(need_ab.isNotNull(), da)).alias("applied_da"),
        applied(F.when(need_ab.isNotNull(), db)).alias("applied_db"),
    )


def trimmed_centre(df: DataFrame, group: str, a: str, b: str, radius: float = RADIUS, rounds: int = ROUNDS) -> DataFrame:
    """group, a, b, share: from the median, ``rounds`` times the mean of the values within
    ``radius`` of the last centre; a round that keeps nothing ends it. share is that of the last
    membership test, which precedes the last mean."""
    values = df.select(group, F.col(a).alias("_a"), F.col(b).alias("_b"))
    # Each round reads the counts of different pairs, one exchange for all rounds.
    rows = values.groupBy(group, "_a", "_b").agg(F.count(F.lit(1)).alias("_n"))
    centre = values.groupBy(group).agg(
        F.median("_a").alias("a"), F.median("_b").alias("b"), F.lit(1.0).alias("share"), F.lit(False).alias("done")
    )
    for _ in range(rounds):
        da, db = F.col("_a") - F.col("a"), F.col("_b") - F.col("b")
        inside: Column = F.sqrt(da * da + db * db) <= radius
        found = (
            rows.join(centre.select(group, "a", "b"), group)
            .groupBy(group)
            .agg(
                (F.sum(F.when(inside, F.col("_a") * F.col("_n"))) / F.sum(F.when(inside, F.col("_n")))).alias("na"),
                (F.sum(F.when(inside, F.col("_b") * F.col("_n"))) / F.sum(F.when(inside, F.col("_n")))).alias("nb"),
                (F.sum(F.when(inside, F.col("_n")).otherwise(0)) / F.sum("_n")).alias("ns"),
            )
        )
        step = centre.join(found, group)
        keep = F.col("done")
        centre = step.select(
            group,
            F.when(keep | (F.col("ns") == 0), F.col("a")).otherwise(F.col("na")).alias("a"),
            F.when(keep | (F.col("ns") == 0), F.col("b")).otherwise(F.col("nb")).alias("b"),
            F.when(keep, F.col("share")).otherwise(F.col("ns")).alias("share"),
            (keep | (F.col("ns") == 0)).alias("done"),
        )
    return centre.drop("done")


def measure(pixels: DataFrame, image: str, valid: float = VALID, neutral: float = NEUTRAL, radius: float = RADIUS) -> DataFrame:
    """image, l, a, b, valid_share, neutral_share of pixel rows (image, l, a, b). Only pixels away
    from black and white count; an image with too few has no measure, one with too few neutral
    pixels has no cast (a, b)."""
    inside = F.col("l").between(*VALID_L)
    light = pixels.groupBy(image).agg(
        F.avg(F.when(inside, 1.0).otherwise(0.0)).alias("valid_share"), F.median(F.when(inside, F.col("l"))).alias("_l")
    )
    centre = trimmed_centre(pixels.filter(inside), image, "a", "b", radius)
    enough = F.col("valid_share") >= valid
    cast = enough & (F.col("share") >= neutral)
    return light.join(centre, image, "left").select(
        image, F.when(enough, F.col("_l")).alias("l"), F.when(cast, F.col("a")).alias("a"), F.when(cast, F.col("b")).alias("b"),
        "valid_share", F.when(enough, F.col("share")).otherwise(0.0).alias("neutral_share"),
    )


def corrected(pixels: DataFrame, source_l: Column, new_l: Column, da: Column, db: Column) -> DataFrame:
    """Pixel rows with l, a, b moved: lightness by the power curve that takes source_l to new_l,
    colour by the shifts, which fade out towards black and white."""
    gamma = color.tone_gamma(source_l, new_l)
    light = F.when(F.abs(gamma - 1) <= 1e-6, F.col("l")).otherwise(color.tone_curve(clamp(F.col("l"), 0, 100), gamma))
    fade = color.edge_taper(F.col("_l"))
    shifted = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0.0)) * fade).alias(c)
    keep = [c for c in pixels.columns if c not in ("l", "a", "b")]
    return pixels.withColumn("_l", light).select(*keep, F.col("_l").alias("l"), shifted("a", da), shifted("b", db))
