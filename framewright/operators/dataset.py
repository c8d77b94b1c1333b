"""Dataset preparation: profiles, selection, splits, filters and samples without leaks."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions.text import is_night

FILTERED = ("train", "val")
LEAST_IMAGES = 200


def profile(df: DataFrame, key: str, features: list[str], latitude: str | None = None, order: str | None = None) -> DataFrame:
    """n and a mean of each feature by key. Values that are no numbers, or negative, are missing:
    they add nothing but count in the denominator, which is all rows."""
    mean = lambda c: F.sum(F.when(F.expr(f"try_cast(`{c}` AS double)") >= 0, F.expr(f"try_cast(`{c}` AS double)")).otherwise(0.0)) / F.count(F.lit(1))
    out = [F.count(F.lit(1)).alias("n"), *[mean(c).alias(c) for c in features]]
    if latitude and order:
        out.append(F.min_by(F.abs(latitude), order).alias("lat"))
    return df.groupBy(key).agg(*out)


def usable(profiles: DataFrame, masks: DataFrame, key: str, least: int = LEAST_IMAGES) -> DataFrame:
    """Profiles of enough rows whose mask is neither empty nor full."""
    some = masks.filter((F.col("covered") > 0) & (F.col("covered") < F.col("pixels"))).select(key)
    return profiles.filter(F.col("n") >= least).join(some, key, "left_semi")


def farthest_points(df: DataFrame, key: str, features: list[str], k: int) -> DataFrame:
    """k rows that cover the range of features: the one nearest the mean first, then always the one
    farthest from those chosen; ties go to the smaller key. Features are standardised with the
    population deviation. ``df`` is a table of profiles, so k rounds of one aggregation each."""
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in features]).first()
    if stats[0] is None:
        return df.limit(0).withColumn("pick", F.lit(1))
    z = df.select(key, *[((F.col(c) - stats[f"m_{c}"]) / (stats[f"s_{c}"] + 1e-9)).alias(c) for c in features])
    z.persist()  # each round reads it; what an executor loses is computed again
    gap = lambda at: F.sqrt(sum(((F.col(c) - float(at[c])) * (F.col(c) - float(at[c])) for c in features), F.lit(0.0)))
    far = z.withColumn("_d", gap(dict.fromkeys(features, 0.0)))
    first = far.orderBy("_d", key).first()
    chosen = [first] if first else []
    far = z.withColumn("_d", gap(first)) if first else far
    while chosen and len(chosen) < k:
        nxt = far.filter(~F.col(key).isin([r[key] for r in chosen])).orderBy(F.desc("_d"), key).first()
        if nxt is None:
            break
        chosen.append(nxt)
        far = far.withColumn("_d", F.least("_d", gap(nxt)))
    z.unpersist()
    picked = df.sparkSession.createDataFrame(
        [(r[key], i + 1) for i, r in enumerate(chosen)], df.select(key).schema.add("pick", T.IntegerType())
    )
    return df.join(picked, key)


def split_sizes(n: int, val: float, test: float) -> tuple[int, int]:
    """(test, val): one at least each, halves to even."""
    return max(1, round(n * test)), max(1, round(n * val))


def shuffled_splits(ids: list[str], seed: int, val: float, test: float) -> dict[str, list[str]]:
    """Splits of a short list of numeric ids by a seeded generator on the driver."""
    order = sorted(ids, key=int)
    random.Random(seed).shuffle(order)
    t, v = split_sizes(len(order), val, test)
    cut = {"test": order[:t], "val": order[t : t + v], "train": order[t + v :]}
    return {k: sorted(x, key=int) for k, x in cut.items()}


def hashed_splits(df: DataFrame, group: str, seed: int, val: float, test: float) -> DataFrame:
    """group, split: whole groups in the order of a seeded hash, cut into test, val and train."""
    groups = df.select(group).distinct()
    order = Window.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(group)).cast("binary")), group)
    every = Window.partitionBy(F.lit(1))
    n = F.count(F.lit(1)).over(every)
    cut = lambda share: F.greatest(F.lit(1), F.bround(n * share).cast("int"))
    return groups.withColumns({"_r": F.row_number().over(order), "_t": cut(test), "_v": cut(val)}).select(
        group,
        F.when(F.col("_r") <= F.col("_t"), "test").when(F.col("_r") <= F.col("_t") + F.col("_v"), "val").otherwise("train").alias("split"),
    )


def sample_per_group(df: DataFrame, group: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows of each group, without replacement, by a seeded hash of the key."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    w = Window.partitionBy(group).orderBy(order, key)
    return df.withColumn("pick", F.row_number().over(w)).filter(F.col("pick") <= n)


def disposition(split: Column, hour: Column, readable: Column, light: Column, dark: float | None = None) -> Column:
    """Why a row is dropped, the first reason that holds, or kept."""
    night = split.isin(*FILTERED) & is_night(hour)
    out = F.when(night, "night").when(~readable, "unreadable")
    if dark is not None:
        out = out.when(light < dark, "dark")
    return out.otherwise("kept")


def early_stop(df: DataFrame, order: str, value: str, patience: int) -> DataFrame:
    """best so far, streak since the last strict improvement, and whether to stop here. One ordered
    series, as a training log is."""
    w = Window.orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    seen = df.withColumns({"_better": F.coalesce(F.col(value) > F.max(value).over(before), F.lit(True)), "_i": F.row_number().over(w)})
    last = F.max(F.when(F.col("_better"), F.col("_i"))).over(w)
    return seen.withColumns(
        {"best": F.max(value).over(w), "best_at": F.max(F.when(F.col("_better"), F.col(order))).over(w), "streak": (F.col("_i") - last).cast("long")}
    ).withColumn("stop", F.col("streak") >= patience).drop("_better", "_i")
