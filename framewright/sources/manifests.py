"""Manifests, reports and logs as CSV, JSON and JSON lines with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright import schemas


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Prepared rows; an empty hour is NULL, a file without night counts as day."""
    df = spark.read.schema(schemas.MANIFEST).csv(path, header=True, enforceSchema=False)
    return df.withColumn("night", F.coalesce("night", F.lit(0)))


def write_manifest(df: DataFrame, path: str, split: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(split).csv(path, header=True)


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """(split, camera) rows of a splits document."""
    doc = spark.read.schema(schemas.SPLITS).json(path, multiLine=True)
    each = F.array(*[F.struct(F.lit(s).alias("split"), F.col(s).alias("cameras")) for s in ("test", "val", "train")])
    return doc.select(F.explode(each).alias("x")).select("x.split", F.explode("x.cameras").alias("camera"))


def splits_document(rows: DataFrame, seed: int) -> DataFrame:
    """One row: the splits as a document, cameras in number order."""
    by = lambda s: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("split") == s, F.struct(F.col("camera").cast("int").alias("n"), "camera")))), lambda x: x["camera"]
    ).alias(s)
    return rows.agg(F.lit(seed).alias("seed"), by("test"), by("val"), by("train"))


def read_metadata(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A wide CSV read as text under the given names, by place: names may differ by case only."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=True)


def read_training_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TRAINING_LOG).json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """One JSON document from a one-row frame."""
    df.coalesce(1).write.mode("overwrite").json(path)


def best_effort(write, *args) -> str | None:
    """Run a side write; its failure is returned as text and never stops the query."""
    try:
        write(*args)
    except Exception as e:  # noqa: BLE001  any failure of a log is tolerable
        return f"{type(e).__name__}: {e}"
    return None
