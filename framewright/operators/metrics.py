"""Evaluation by pooled counts, distribution summaries and weighted quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.numeric import ratio

COUNTS = ("inter_pos", "union_pos", "inter_neg", "union_neg")


def counts(truth: Column, predicted: Column, weight: Column | None = None) -> list[Column]:
    """Sums of intersections and unions of both classes, and the number of rows."""
    w = F.lit(1) if weight is None else weight
    total = lambda c: F.coalesce(F.sum(F.when(c, w)), F.lit(0)).cast("long")
    return [
        total(truth & predicted).alias("inter_pos"), total(truth | predicted).alias("union_pos"),
        total(~truth & ~predicted).alias("inter_neg"), total(~truth | ~predicted).alias("union_neg"),
        F.count(F.lit(1)).alias("images"),
    ]


def rates(df: DataFrame) -> DataFrame:
    """Ratios of the sums; NULL where a union is empty, and the mean where either is."""
    out = df.withColumns(
        {"pos_iou": ratio(F.col("inter_pos"), F.col("union_pos")), "neg_iou": ratio(F.col("inter_neg"), F.col("union_neg"))}
    )
    return out.withColumn("miou", (F.col("pos_iou") + F.col("neg_iou")) / 2)


def cube(df: DataFrame, keys: list[str], truth: Column, predicted: Column) -> DataFrame:
    """Counts and rates at every combination of keys; grain tells which keys are summed over."""
    return rates(df.cube(*keys).agg(F.grouping_id().cast("long").alias("grain"), *counts(truth, predicted)))


def pooled(stored: DataFrame, keys: list[str]) -> DataFrame:
    """The same from rows that hold counts."""
    sums = [F.sum(c).cast("long").alias(c) for c in (*COUNTS, "images")]
    return rates(stored.cube(*keys).agg(F.grouping_id().cast("long").alias("grain"), *sums))


def macro(df: DataFrame, key: str, truth: Column, predicted: Column) -> DataFrame:
    """Mean over groups of each rate, undefined ones left out."""
    per = rates(df.groupBy(key).agg(*counts(truth, predicted)))
    return per.agg(
        F.count(F.lit(1)).alias("groups"), *[F.avg(c).alias(f"macro_{c}") for c in ("pos_iou", "neg_iou", "miou")]
    )


def report(cubed: DataFrame, key: str, condition: str) -> DataFrame:
    """The nested report of a cube over (key, condition) as one JSON document."""
    rates_of = F.struct("images", "pos_iou", "neg_iou", "miou")
    per_key = cubed.filter("grain = 1").select(F.struct(F.col(key).cast("string").alias("k"), rates_of.alias("v")).alias("e"))
    per_cond = cubed.filter("grain = 2").select(F.struct(F.col(condition).cast("string").alias("k"), rates_of.alias("v")).alias("e"))
    top = cubed.filter("grain = 3").select(rates_of.alias("pooled"))
    fold = lambda d, n: d.agg(F.map_from_entries(F.array_sort(F.collect_list("e"))).alias(n))
    return (
        top.crossJoin(F.broadcast(fold(per_key, "per_key"))).crossJoin(F.broadcast(fold(per_cond, "by_condition")))
        .select(F.to_json(F.struct("pooled", "per_key", "by_condition")).alias("report"))
    )


def weighted_mean(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.sum(weight).cast("double").alias("weight"), ratio(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("mean")
    )


def weighted_quantiles(df: DataFrame, keys: list[str], value: str, weight: str, qs: dict[str, float]) -> DataFrame:
    """The first value, in order, at which the summed weight reaches q of all. Equal values are
    summed first, so order among them is of no account."""
    rows = df.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    run = F.sum("_w").over(Window.partitionBy(*keys).orderBy(value))
    total = F.sum("_w").over(Window.partitionBy(*keys))
    marked = rows.withColumns({"_run": run, "_all": total})
    return marked.groupBy(*keys).agg(
        *[F.min(F.when(F.col("_run") >= F.lit(q) * F.col("_all"), F.col(value))).alias(n) for n, q in qs.items()]
    )


def distribution(df: DataFrame, keys: list[str], value: str, bright: Column) -> DataFrame:
    """Exact percentiles 5, 50, 95, mean, population deviation and the share of ``bright``."""
    p = F.percentile(value, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return (
        df.groupBy(*keys)
        .agg(p.alias("_p"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.avg(bright.cast("int")).alias("share"))
        .select(*keys, *[F.col("_p")[i].alias(n) for i, n in enumerate(("p05", "p50", "p95"))], "mean", "std", "share")
    )


def zone_ratio(df: DataFrame, keys: list[str], value: str, position: Column, eps: float = 1e-6) -> DataFrame:
    """Mean over the top third (position under 1/3) by that over the bottom third."""
    return df.groupBy(*keys).agg(
        (
            F.avg(F.when(position < F.lit(1 / 3), F.col(value))) / (F.avg(F.when(position >= F.lit(2 / 3), F.col(value))) + eps)
        ).alias("zone_ratio")
    )


def difference(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Mean, 99th percentile and maximum of |a - b|."""
    d = F.abs(F.col(a) - F.col(b))
    return df.groupBy(*keys).agg(
        F.avg(d).alias("mean_diff"), F.percentile(d, F.lit(0.99)).alias("p99_diff"), F.max(d).alias("max_diff")
    )
