"""Rows to store: runs with their children, classifications, names, privacy and argument checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.operators import normalize, scoring


def sync_records(df: DataFrame, group: str, source: str, run_of: Column, at: str) -> tuple[DataFrame, DataFrame]:
    """(runs, images): one parent row for each group with its target, one child row for each member
    with its shifts, tied by run_id. ``run_of`` gives the id from the group."""
    out = normalize.sync(df, group).withColumn("run_id", run_of)
    goals = normalize.targets(df, group)
    target = F.when(F.col("target_l").isNotNull(), F.to_json(F.struct(F.col("target_l").alias("l"), F.col("target_a").alias("a"), F.col("target_b").alias("b"))))
    limits = F.to_json(F.struct(F.lit(normalize.CAP_L).alias("cap_l"), F.lit(normalize.CAP_AB).alias("cap_ab"), F.lit(normalize.GROUP).alias("group")))
    runs = goals.withColumn("run_id", run_of).select(
        F.col("run_id").alias("id"), F.lit(at).alias("timestamp"), F.col(group).cast("string").alias("group_name"), F.col("members").cast("int").alias("n_images"),
        target.alias("target"), F.lit(normalize.STRENGTH).alias("strength"), limits.alias("thresholds"),
    )
    stats = F.to_json(F.struct("l", "a", "b"))
    images = out.select(
        "run_id", F.col(source).cast("string").alias("source"), "status", stats.alias("stats"), "needed_dl", "needed_dab", "applied_dl", "applied_da", "applied_db", "reason"
    )
    return runs, images


def classification_rows(df: DataFrame, source: str, at: str) -> DataFrame:
    """One row for each feature record: call, label, confidence, the record, its room scores as a
    map by name, and the thresholds, as JSON; no label by hand yet."""
    rooms = F.map_from_arrays(F.array(*[F.lit(r) for r in scoring.ROOMS]), F.array(*[scoring.score(terms) for terms in scoring.ROOMS.values()]))
    scored = scoring.choose_room(scoring.classify(scoring.logged(df)).withColumn("scores", F.to_json(rooms)))
    inside = F.col("call") == "interior"
    return scored.select(
        F.lit(at).alias("timestamp"), F.col(source).cast("string").alias("source"), "call", F.when(inside, F.col("room")).otherwise(F.col("call")).alias("label"),
        F.when(inside, F.col("probability") * F.col("confidence")).otherwise(F.col("confidence")).alias("confidence"), "features", "scores", "thresholds",
        F.lit(None).cast("string").alias("true_label"),
    )


def without_private(df: DataFrame, private: list[str]) -> DataFrame:
    """``df`` without private columns, at the top or inside structs; raises if one is left."""
    kept = df
    for name in private:
        top, _, inner = name.partition(".")
        if top in kept.columns:
            kept = kept.withColumn(top, F.col(top).dropFields(inner)) if inner else kept.drop(top)
    left = [n for n in private if n in kept.columns or ("." in n and n.split(".")[0] in kept.columns and n.split(".")[1] in kept.select(f"{n.split('.')[0]}.*").columns)]
    if left:
        raise ValueError(f"private columns are left: {left}")
    return kept


def output_name(stems: Column, kind: str) -> Column:
    """first-last.kind of the sorted names of a group's files."""
    order = F.array_sort(stems)
    return F.concat(F.element_at(order, 1), F.lit("-"), F.element_at(order, -1), F.lit(f".{kind}"))


def batches_needed(n: Column, size: int) -> Column:
    """n / size, rounded up."""
    return F.floor((n + (size - 1)) / size).cast("long")


def aspect_error(df: DataFrame, keys: list[str], w: Column, h: Column, true: Column, inside: Column) -> DataFrame:
    """Median percent error of width over height against the truth, items out of frame left out."""
    error = F.when(inside, F.abs(w / h - true) / true * 100)
    return df.groupBy(*keys).agg(F.count_if(inside).alias("judged"), F.median(error).alias("median_error"))


# ------------------------------------------------------------------ argument checks

def check_tiling(tile: int, overlap: int) -> None:
    if tile < 0 or overlap < 0 or (tile and tile < 2 * overlap):
        raise ValueError("tile must be 0 or at least two overlaps")


def check_fractions(val: float, test: float) -> None:
    if not (0 < val < 1 and 0 < test < 1 and val + test < 1):
        raise ValueError("val and test must lie in (0, 1) and leave rows to train on")


def refuse_overwrite(inputs: list[str], output: str) -> None:
    if output in inputs:
        raise ValueError("the output is one of the inputs")
