"""Event-sourced job ledger: states are derived from an append-only transition log.

A table of jobs (job_id, bracket_files, ...) and a log (run_id, job_id, old_status, new_status,
timestamp). Updates append; nothing is rewritten, so a broken write leaves no half state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("pending", "running", "complete", "failed")


def new_only(candidates: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Candidates whose key is not there yet, one row for each key."""
    return candidates.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def enqueue_report(candidates: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """One row: added and skipped."""
    seen = existing.select(F.col(key).alias("_k")).distinct()
    marked = candidates.join(seen, candidates[key] == seen["_k"], "left")
    return marked.agg(
        F.count_distinct(F.when(F.col("_k").isNull(), F.col(key))).alias("added"),
        (F.count(F.lit(1)) - F.count_distinct(F.when(F.col("_k").isNull(), F.col(key)))).alias("skipped"),
    )


def current(log: DataFrame) -> DataFrame:
    """job_id, status, n_runs: the latest state of each job."""
    return log.groupBy("job_id").agg(F.max_by("new_status", "run_id").alias("status"), F.count(F.lit(1)).alias("n_runs"))


def transitions(log: DataFrame, change: Column, when: Column, at: Column) -> DataFrame:
    """Log rows to append: every job whose state meets ``when`` goes to ``change``."""
    return current(log).filter(when).select(
        "job_id", F.col("status").alias("old_status"), change.alias("new_status"), at.alias("timestamp")
    )


def recover(log: DataFrame, at: Column) -> DataFrame:
    """running -> pending, after a crash."""
    return transitions(log, F.lit("pending"), F.col("status") == "running", at)


def retry(log: DataFrame, at: Column) -> DataFrame:
    """failed -> pending."""
    return transitions(log, F.lit("pending"), F.col("status") == "failed", at)


def append(log: DataFrame, rows: DataFrame) -> DataFrame:
    """The log with rows behind it, numbered on from its largest run_id in job order."""
    from pyspark.sql import Window

    top = log.agg(F.coalesce(F.max("run_id"), F.lit(0)).alias("_top"))
    # One row for each job that changes; numbers need one order over them.
    numbered = rows.crossJoin(F.broadcast(top)).withColumn(
        "run_id", F.col("_top") + F.row_number().over(Window.orderBy("job_id"))
    )
    return log.unionByName(numbered.drop("_top").select(*log.columns))


def rollup(states: DataFrame, column: str = "status", statuses=STATUSES) -> DataFrame:
    """Jobs by status, all statuses present."""
    spark = states.sparkSession
    wanted = spark.createDataFrame([(s,) for s in statuses], f"{column} string")
    counted = states.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(counted, column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def queue_head(states: DataFrame, status: str = "pending") -> DataFrame:
    """The oldest job in a state; no row if there is none."""
    return states.filter(F.col("status") == status).orderBy("job_id").limit(1)


def history(jobs: DataFrame) -> DataFrame:
    """Jobs in order; wall time and peak memory are missing independently of each other."""
    return jobs.select(
        "job_id", "status", F.col("wall_seconds").isNotNull().alias("timed"), F.col("peak_memory_mb").isNotNull().alias("measured"),
        "wall_seconds", "peak_memory_mb",
    ).orderBy("job_id")


def compare_modes(benchmarks: DataFrame, key: str, value: str, mode: str, a: str, b: str) -> DataFrame:
    """Two modes of one key side by side, by conditional aggregation."""
    pick = lambda m: F.max(F.when(F.col(mode) == m, F.col(value)))
    return benchmarks.groupBy(key).agg(pick(a).alias(a), pick(b).alias(b)).withColumn("change", F.col(b) - F.col(a))


def missing_files(jobs: DataFrame, files: str, listing: DataFrame, path: str) -> DataFrame:
    """Paths that jobs name and the listing lacks."""
    named = jobs.select("job_id", F.explode(F.from_json(files, "array<string>")).alias(path))
    return named.join(listing.select(path), path, "left_anti")
