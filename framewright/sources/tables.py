"""Ledger tables on disk: appends and overwrites with Spark's commit protocol."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright import schemas
from framewright.operators import learn, ledger


class Store:
    """Tables under one path, one folder each, Parquet. Columns added later read as NULL."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _at(self, name: str):
        """(file system, path) of a folder of the store."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _move(self, name: str, to: str) -> None:
        (fs, a), (_, b) = self._at(name), self._at(to)
        if not fs.rename(a, b):
            raise OSError(f"{a.toString()} could not be renamed")

    def _drop(self, name: str) -> None:
        fs, p = self._at(name)
        fs.delete(p, True)

    def _has(self, name: str) -> bool:
        fs, p = self._at(name)
        return fs.exists(p)

    def exists(self, name: str) -> bool:
        if not self._has(name) and self._has(f"_old-{name}"):
            self._move(f"_old-{name}", name)  # a replacement stopped between its two renames
        return self._has(name)

    def replace(self, name: str, df: DataFrame) -> None:
        """Put ``df``, which may read the table itself, in a table's place: it is written in full
        beside the table, then two renames swap them. Stopped anywhere, the next use finds the old
        table or the new one, whole."""
        staged = f"_staged-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{staged}")
        if self.exists(name):
            self._drop(f"_old-{name}")
            self._move(name, f"_old-{name}")
        self._move(staged, name)
        self._drop(f"_old-{name}")

    def read(self, name: str, schema: str) -> DataFrame:
        if not self.exists(name):
            return self.spark.createDataFrame([], schema)
        return schemas.migrated(self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/{name}"), schema)

    def append(self, name: str, df: DataFrame) -> None:
        self.exists(name)
        df.write.mode("append").parquet(f"{self.path}/{name}")

    def enqueue(self, brackets: DataFrame, at: str) -> dict[str, int]:
        """Add brackets (bracket_files, output_path, settings) that the ledger lacks, each with its
        first transition. Jobs are written before transitions: a job without one is pending too."""
        jobs = self.read("jobs", schemas.JOBS)
        fresh = ledger.new_only(brackets, jobs, "bracket_files")
        top = jobs.agg(F.coalesce(F.max("job_id"), F.lit(0)).alias("_top"))
        from pyspark.sql import Window

        number = F.row_number().over(Window.orderBy("bracket_files"))
        rows = fresh.crossJoin(F.broadcast(top)).select(
            (F.col("_top") + number).alias("job_id"), "bracket_files", F.lit("pending").alias("status"), "output_path", F.lit(at).alias("created_at"), "settings",
        )
        staged = f"_staged-{uuid.uuid4().hex}"
        schemas.migrated(rows, schemas.JOBS).write.parquet(f"{self.path}/{staged}")
        rows = self.spark.read.parquet(f"{self.path}/{staged}")
        added = rows.count()
        self.append("jobs", rows)
        self.log(rows.select("job_id", F.lit(None).cast("string").alias("old_status"), F.lit("pending").alias("new_status"), F.lit(at).alias("timestamp")))
        skipped = brackets.count() - added
        self._drop(staged)
        return {"added": added, "skipped": skipped}

    def log(self, rows: DataFrame) -> None:
        """Append transitions."""
        runs = self.read("runs", schemas.RUNS)
        top = runs.agg(F.coalesce(F.max("run_id"), F.lit(0))).first()[0]
        from pyspark.sql import Window

        number = F.lit(top) + F.row_number().over(Window.orderBy("job_id"))
        self.append("runs", schemas.migrated(rows.withColumn("run_id", number), schemas.RUNS))

    def states(self) -> DataFrame:
        return ledger.current(self.read("runs", schemas.RUNS))

    def set_status(self, job_id: int, status: str, at: str) -> None:
        if status not in schemas.STATUSES:
            raise ValueError(f"no such status: {status}")
        now = self.states().filter(F.col("job_id") == job_id)
        self.log(now.select("job_id", F.col("status").alias("old_status"), F.lit(status).alias("new_status"), F.lit(at).alias("timestamp")))

    def recover(self, at: str) -> None:
        self.log(ledger.recover(self.read("runs", schemas.RUNS), F.lit(at)))

    def retry(self, at: str) -> None:
        self.log(ledger.retry(self.read("runs", schemas.RUNS), F.lit(at)))

    def forget(self, key: str | None = None, value=None) -> int:
        """Remove adjustments by key (or all); the number removed."""
        kept, gone = learn.forget(self.read("adjustments", schemas.ADJUSTMENTS), key, value)
        removed = gone.first()["removed"]
        self.replace("adjustments", kept)
        return removed
