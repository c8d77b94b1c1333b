"""Grouping timestamped records into size-dependent sessions, chunks and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST, LONG_GAP, SHORT_GAP = 3, 30.0, 10.0


def seconds_between(a: str | Column, b: str | Column) -> Column:
    return F.timestamp_diff("MICROSECOND", a, b) / F.lit(1e6)


def assign_sessions(
    df: DataFrame,
    keys: list[str],
    ts: str,
    tie: str,
    duration: str | None = None,
    least: int = LEAST,
    long_gap: float = LONG_GAP,
    short_gap: float = SHORT_GAP,
) -> DataFrame:
    """``df`` with a column session (from 0 for each key).

    A record joins the current session if it starts within long_gap of the previous record's end,
    unless the session has ``least`` records already and the gap exceeds short_gap. Gaps up to
    short_gap never split and gaps over long_gap always do; so windows label both kinds of edges,
    and only the sizes of the runs between short edges are folded, inside one stretch between long
    edges. Splits by key and by stretch, both in parallel.
    """
    order = Window.partitionBy(*keys).orderBy(ts, tie)
    end_gap = seconds_between(F.lag(ts).over(order), ts)
    if duration:
        end_gap = end_gap - F.coalesce(F.lag(duration).over(order), F.lit(0.0))
    edge = df.withColumn("_gap", end_gap)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = edge.withColumns({"_run": count(F.col("_gap") > short_gap), "_stretch": count(F.col("_gap") > long_gap)})
    runs = marked.groupBy(*keys, "_stretch", "_run").agg(F.count(F.lit(1)).alias("_n"))
    folded = F.aggregate(
        "_sizes",
        F.struct(F.lit(0).cast("long").alias("size"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, run: F.struct(
            F.when(acc["size"] < least, acc["size"] + run["_n"]).otherwise(run["_n"]).alias("size"),
            F.when((acc["size"] < least), acc["at"]).otherwise(acc["at"] + 1).alias("at"),
            F.concat(
                acc["out"], F.array(F.when(acc["size"] < least, acc["at"]).otherwise(acc["at"] + 1))
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    stretches = (
        runs.groupBy(*keys, "_stretch")
        .agg(F.array_sort(F.collect_list(F.struct("_run", "_n"))).alias("_sizes"))
        .withColumn("_local", folded)
    )
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    labels = (
        stretches.withColumn("_base", F.coalesce(F.sum(F.element_at("_local", -1) + 1).over(before), F.lit(0)))
        .select(*keys, "_base", F.explode(F.arrays_zip("_sizes", "_local")).alias("x"))
        .select(*keys, F.col("x._sizes._run").alias("_run"), (F.col("_base") + F.col("x._local")).cast("long").alias("session"))
    )
    return marked.join(labels, [*keys, "_run"]).drop("_gap", "_run", "_stretch")


def brackets(sessions: DataFrame, keys: list[str], ts: str, tie: str, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(sessions of ``least`` records or more, rejects): one row each with its members in order."""
    grouped = sessions.groupBy(*keys, "session").agg(
        F.count(F.lit(1)).alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct(ts, tie))), lambda x: x[tie]).alias("members"),
    )
    return grouped.filter(F.col("n") >= least), grouped.filter(F.col("n") < least)


def chunks_by_name(df: DataFrame, keys: list[str], ts: str, name: str, size: int = LEAST) -> DataFrame:
    """The fallback where any time of a key is missing: records in name order, ``size`` at a time;
    complete is false for what is left over. Keys without a missing time are left out."""
    whole = Window.partitionBy(*keys)
    place = F.row_number().over(whole.orderBy(name)) - 1
    return (
        df.withColumn("_missing", F.bool_or(F.col(ts).isNull()).over(whole))
        .filter("_missing")
        .withColumn("chunk", F.floor(place / size).cast("long"))
        .withColumn("complete", F.count(F.lit(1)).over(Window.partitionBy(*keys, "chunk")) == size)
        .drop("_missing")
    )


def grouped(
    df: DataFrame, keys: list[str], ts: str, name: str, duration: str | None = None,
    least: int = LEAST, long_gap: float = LONG_GAP, short_gap: float = SHORT_GAP,
) -> DataFrame:
    """Every record with its group, way and whether the group is complete. The keys name one input:
    if all its records have a time, the input is grouped by time; if one lacks it, the whole input
    goes by name, ``least`` records at a time."""
    lacking = F.bool_or(F.col(ts).isNull()).over(Window.partitionBy(*keys))
    timed = df.withColumn("_lacking", lacking).filter("not _lacking").drop("_lacking")
    by_time = assign_sessions(timed, keys, ts, name, duration, least, long_gap, short_gap)
    members = F.count(F.lit(1)).over(Window.partitionBy(*keys, "session"))
    by_name = chunks_by_name(df, keys, ts, name, least)
    return by_time.select(*df.columns, F.col("session").alias("group"), F.lit("time").alias("way"), (members >= least).alias("complete")).unionByName(
        by_name.select(*df.columns, F.col("chunk").alias("group"), F.lit("name").alias("way"), "complete")
    )


def middle(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The record at index n div 2 of each key."""
    w = Window.partitionBy(*keys)
    return (
        df.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count(F.lit(1)).over(w)})
        .filter(F.col("_i") == F.floor(F.col("_n") / 2))
        .drop("_i", "_n")
    )


def islands(df: DataFrame, keys: list[str], value: str, jump: float) -> DataFrame:
    """Runs of values that follow within ``jump``: key, run, low, high, n."""
    order = Window.partitionBy(*keys).orderBy(value)
    gap = F.col(value) - F.lag(value).over(order)
    return (
        df.withColumn("_gap", gap)
        .withColumn("run", F.sum(F.when(F.col("_gap") > jump, 1).otherwise(0)).over(order))
        .groupBy(*keys, "run")
        .agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(F.lit(1)).alias("n"))
    )


def overlapping(runs: DataFrame, low: Column, high: Column) -> DataFrame:
    """Runs that share a point with [low, high]."""
    return runs.filter((F.col("low") <= high) & (F.col("high") >= low))
