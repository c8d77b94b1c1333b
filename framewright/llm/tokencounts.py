"""Operator 1, delta-maintained token counts.

A change is an insert, a delete or a revised count of one document. It carries the counts before
and after it, so a batch of changes becomes signed sums by (source, lang, tokenizer_version)
without looking at earlier data: an insert adds its counts, a delete takes them away, a revision
does both (also across versions). Sums are additive, so totals are the sum of all batches' deltas
in any order.

Store: every write goes to a folder of its own, ``<path>/deltas/batch=<id>/<attempt>`` (one row for
each key that the batch moves), and is committed by the file ``<path>/commits/<id>``, made last and
only if absent, which names that folder. A batch that is committed already is skipped; of a write
that broke off nothing is read; so a batch may be delivered any number of times, at once too, and
counts once. ``compact`` folds committed deltas into one: its commit file also names the batches
that it replaces, which no reader counts from then on, and their folders go only after that. At
whatever step a fold stops, totals stay whole, and calling it again ends what was left.

Deltas and totals are as many as the keys, whatever the corpus. Hot sources cost nothing: rows are
summed in the tasks that read them.

Null sources and languages are keys of their own. Null or empty texts count 0 tokens and 1
document. Repeated changes within a batch count each. Empty batches commit nothing but the mark.
Keys whose documents are all gone stay out of ``totals``. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import materialize, shared_dir

KEYS = ("source", "lang", "tokenizer_version")
SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"
WORDS_VERSION, BPE_VERSION = "words-1", "byte_bpe_50k-1"
TOKENIZER_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that cuts text before byte-pair merges in this vocabulary.
BPE_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def word_count(text):
    """Whitespace-separated words, null as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _bpe(batches: Iterator[pd.DataFrame], shared) -> Iterator[pd.DataFrame]:
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in shared.value.splitlines() if x)}
    codec = tiktoken.Encoding("bpe", pat_str=BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})
    for pdf in batches:
        pdf["n_tokens"] = [len(codec.encode_ordinary(t)) if t else 0 for t in pdf["text"]]
        yield pdf.drop(columns="text")


def bpe_counts(docs: DataFrame, tokenizer_file: str = TOKENIZER_FILE) -> DataFrame:
    """``docs`` with n_tokens in place of text. The vocabulary file (under 1 MB) is read on the
    driver and sent to the tasks."""
    with open(tokenizer_file, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = docs.drop("text").withColumn("n_tokens", F.lit(0).cast("long")).schema
    ordered = docs.select(*[c for c in docs.columns if c != "text"], "text")
    return ordered.mapInPandas(lambda it: _bpe(it, shared), schema)


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums of changes (op, source, lang, old_version, old_tokens, new_version, new_tokens):
    op is insert (new only), delete (old only) or revise (both)."""
    minus = F.when(F.col("op").isin("delete", "revise"), F.struct(F.col("old_version").alias("tokenizer_version"), F.lit(-1).cast("long").alias("n_docs"), (-F.col("old_tokens")).alias("n_tokens")))
    plus = F.when(F.col("op").isin("insert", "revise"), F.struct(F.col("new_version").alias("tokenizer_version"), F.lit(1).cast("long").alias("n_docs"), F.col("new_tokens").alias("n_tokens")))
    return (
        changes.select("source", "lang", F.explode(F.filter(F.array(minus, plus), lambda x: x.isNotNull())).alias("d"))
        .groupBy("source", "lang", F.col("d.tokenizer_version").alias("tokenizer_version"))
        .agg(F.sum("d.n_docs").alias("n_docs"), F.sum("d.n_tokens").alias("n_tokens"))
        .filter((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))
    )


def diff_snapshots(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes between two tables (doc_id, source, lang, tokenizer_version, n_tokens), unique by
    doc_id and version. A document that moved to another source or language is a delete and an
    insert."""
    o = old.select("doc_id", *KEYS, "n_tokens").alias("o")
    n = new.select("doc_id", *KEYS, "n_tokens").alias("n")
    both = o.join(
        n,
        (F.col("o.doc_id") == F.col("n.doc_id"))
        & F.col("o.tokenizer_version").eqNullSafe(F.col("n.tokenizer_version"))
        & F.col("o.source").eqNullSafe(F.col("n.source"))
        & F.col("o.lang").eqNullSafe(F.col("n.lang")),
        "full",
    )
    gone, made = F.col("n.doc_id").isNull(), F.col("o.doc_id").isNull()
    return both.filter(gone | made | (F.col("o.n_tokens") != F.col("n.n_tokens"))).select(
        F.when(gone, "delete").when(made, "insert").otherwise("revise").alias("op"),
        F.when(gone, F.col("o.source")).otherwise(F.col("n.source")).alias("source"),
        F.when(gone, F.col("o.lang")).otherwise(F.col("n.lang")).alias("lang"),
        F.col("o.tokenizer_version").alias("old_version"),
        F.col("o.n_tokens").alias("old_tokens"),
        F.col("n.tokenizer_version").alias("new_version"),
        F.col("n.n_tokens").alias("new_tokens"),
    )


class TokenRollup:
    """The stored rollup at ``path`` (any file system that Spark reaches)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _mark(self, batch_id: str) -> list[str] | None:
        """[folder of its deltas, batches it replaces ...] of a committed batch, else None."""
        at = self._Path(f"{self.path}/commits/{batch_id}")
        if not self._fs.exists(at) or not self._fs.getFileStatus(at).getLen():
            return None  # an empty mark is one whose write broke off
        stream = self._fs.open(at)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")
        finally:
            stream.close()

    def _commit(self, batch_id: str, folder: str, replaced: list[str]) -> bool:
        """Make the mark, all of it at once; False if the batch has one."""
        at = self._Path(f"{self.path}/commits/{batch_id}")
        try:
            stream = self._fs.create(at, self._mark(batch_id) is None and self._fs.exists(at))
        except Exception:
            if self._mark(batch_id) is None:
                raise
            return False
        stream.write(bytearray("\n".join([folder, *replaced]).encode()))
        stream.close()
        return True

    def marks(self) -> dict[str, list[str]]:
        at = self._Path(f"{self.path}/commits")
        names = sorted(str(s.getPath().getName()) for s in self._fs.listStatus(at)) if self._fs.exists(at) else []
        return {n: m for n in names if not n.startswith((".", "_")) and (m := self._mark(n)) is not None}

    def committed(self) -> list[str]:
        return list(self.marks())

    def _write(self, batch_id: str, rows: DataFrame) -> str:
        folder = f"batch={batch_id}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/deltas/{folder}")
        return folder

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Commit a batch; False if it was committed before."""
        if self._mark(batch_id) is not None:
            return False
        return self._commit(batch_id, self._write(batch_id, deltas(changes)), [])

    def _live(self) -> dict[str, str]:
        """batch -> folder of the committed batches that no fold replaces."""
        marks = self.marks()
        replaced = {b for m in marks.values() for b in m[1:]}
        return {b: m[0] for b, m in marks.items() if b not in replaced}

    def _stored(self) -> DataFrame | None:
        paths = [f"{self.path}/deltas/{folder}" for folder in self._live().values()]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else None

    def totals(self) -> DataFrame:
        rows = self._stored()
        if rows is None:
            return self.spark.createDataFrame([], SCHEMA)
        return (
            rows.groupBy(*KEYS)
            .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
            .filter((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))
        )

    def compact(self, batch_id: str) -> None:
        """Fold all committed deltas into one batch named ``batch_id``. One fold at a time; a reader
        that listed the batches before it must have ended."""
        live = self._live()
        if live and self._mark(batch_id) is None:
            self._commit(batch_id, self._write(batch_id, self.totals()), list(live))
        live = self._live()
        for b in self.committed():
            if b not in live:
                self._fs.delete(self._Path(f"{self.path}/deltas/batch={b}"), True)


def op1_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents inserted with word counts and, as a second version, estimated byte-pair
    counts; these revised to exact ones; documents labelled quality 0 deleted; one batch
    delivered twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    counted = materialize(
        bpe_counts(
            docs.select(
                "doc_id", "source", "lang", "text",
                word_count(F.col("text")).alias("words"),
                F.coalesce(F.ceil(F.octet_length("text") / 4), F.lit(0)).cast("long").alias("guess"),
            )
        ),
        "token-counts",
    )
    rollup = TokenRollup(spark, f"{shared_dir(spark)}/token-rollup-{uuid.uuid4().hex}")
    none, null = F.lit(None).cast("string"), F.lit(None).cast("long")

    def change(df: DataFrame, op: str, old, new) -> DataFrame:
        return df.select(
            F.lit(op).alias("op"), "source", "lang",
            old[0].alias("old_version"), old[1].alias("old_tokens"), new[0].alias("new_version"), new[1].alias("new_tokens"),
        )

    words, bpe = F.lit(WORDS_VERSION), F.lit(BPE_VERSION)
    absent = (none, null)
    low = counted.join(labels.filter("quality = 0").select("doc_id").distinct(), "doc_id", "left_semi")
    revise = change(counted, "revise", (bpe, F.col("guess")), (bpe, F.col("n_tokens")))
    rollup.apply("1-words", change(counted, "insert", absent, (words, F.col("words"))))
    rollup.apply("2-guess", change(counted, "insert", absent, (bpe, F.col("guess"))))
    rollup.apply("3-revise", revise)
    rollup.apply(
        "4-delete",
        change(low, "delete", (words, F.col("words")), absent).unionByName(
            change(low, "delete", (bpe, F.col("n_tokens")), absent)
        ),
    )
    rollup.apply("3-revise", revise)
    return rollup.totals()
