"""Learned defaults by adaptive moving average over the latest adjustments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.numeric import ema_weight

#: Defaults by parameter, samples needed, least step, rows that count.
DEFAULTS = {"clahe_clip": 1.5, "saturation": 1.1}
LEAST, FLOOR, LATEST = 5, 0.2, 200


def adjustment(df: DataFrame) -> DataFrame:
    """Rows (scene_type, param, auto_value, user_value) with their delta."""
    return df.withColumn("delta", F.col("user_value") - F.col("auto_value"))


def average(df: DataFrame, keys: list[str], order: str, delta: str, latest: int = LATEST, floor: float = FLOOR) -> DataFrame:
    """keys, n, shift: the moving average over each key's ``latest`` rows."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(order))
    kept = df.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= latest)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    weighed = kept.withColumn("_n", n).withColumn("_k", F.col("_n") - F.col("_r") + 1)
    return weighed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(ema_weight(F.col("_k"), F.col("_n"), LEAST, floor) * F.col(delta)).alias("shift")
    )


def learned(defaults: DataFrame, averages: DataFrame, keys: list[str], least: int = LEAST) -> DataFrame:
    """Every default with its learned value; fewer than ``least`` rows change nothing."""
    moved = F.when(F.col("n") >= least, F.col("shift")).otherwise(F.lit(0.0))
    return defaults.join(averages, keys, "left").select(
        *keys, F.coalesce("n", F.lit(0)).cast("long").alias("n"), (F.col("value") + F.coalesce(moved, F.lit(0.0))).alias("value")
    )


def forget(df: DataFrame, key: str | None = None, value=None) -> tuple[DataFrame, DataFrame]:
    """(what stays, one row with the number removed); without a key all rows go."""
    hit = F.lit(True) if key is None else F.col(key).eqNullSafe(value)
    return df.filter(~hit), df.agg(F.count_if(hit).alias("removed"))
