"""Integrity checks as relational operators: nothing is verified by looking at rows on the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: key, side (missing in a, or extra)."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    return left.join(right, key, "left_anti").withColumn("side", F.lit("extra")).unionByName(
        right.join(left, key, "left_anti").withColumn("side", F.lit("missing"))
    )


def completeness(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: keys matched, on the left only, on the right only."""
    x = a.select(F.col(key).alias("_a")).distinct()
    y = b.select(F.col(key).alias("_b")).distinct()
    both = x.join(y, F.col("_a") == F.col("_b"), "full_outer")
    return both.agg(
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("matched"),
        F.count_if(F.col("_b").isNull()).alias("left_only"),
        F.count_if(F.col("_a").isNull()).alias("right_only"),
    )


def dangling(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows without a parent."""
    p = parent.select(F.col(parent_key).alias("_p")).distinct()
    return child.join(p, child[child_key] == p["_p"], "left_anti")


def leaks(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups in more than one split, with the number."""
    return df.groupBy(group).agg(F.count_distinct(split).alias("splits")).filter("splits > 1")


def exact_cover(parts: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """One row: keys covered more than once, keys missing, keys from outside."""
    times = parts.groupBy(F.col(key).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    every = whole.select(F.col(key).alias("_w")).distinct()
    both = times.join(every, F.col("_p") == F.col("_w"), "full_outer")
    return both.agg(
        F.count_if(F.col("_n") > 1).alias("repeated"), F.count_if(F.col("_p").isNull()).alias("uncovered"), F.count_if(F.col("_w").isNull()).alias("foreign")
    )


def changed_settings(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Names of settings that differ, NULL equal to NULL."""
    return F.array_compact(F.array(*[F.when(~a[k].eqNullSafe(b[k]), k) for k in a]))


def tally(checks: dict[str, DataFrame]) -> DataFrame:
    """check, violations: how many rows each check found."""
    each = [d.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(n).alias("check"), "violations") for n, d in checks.items()]
    return reduce(DataFrame.unionByName, each)
