"""Operator 2, line dedup by distinct-site spread.

A line (trimmed, at least ``min_chars`` long) is known by a 64-bit hash. Its sites are counted
with a HyperLogLog sketch for each line hash; sketches are built in the map-side half of the
aggregation and merge by union in the other half, so a line that every document holds costs one
sketch for each task. Sketches are within a known error: lines whose estimate lies within
``band`` standard errors of the threshold (one site at least) get an exact distinct count, the
others are decided by their estimate.

Lines on ``min_sites`` sites or more are boilerplate. Their occurrences are removed from every
document but the first holder of the line (smallest doc_id, then position), so no content leaves
the corpus altogether and one of a set of copies stays whole. ``keep_first=False`` removes all.

Lines join to boilerplate by hash and only hits travel on: one row of line numbers for each
document that loses some. Skewed hashes are split by adaptive execution; the text itself crosses
one shuffle by doc_id. A document that lost everything is dropped in ``clean`` (it held nothing
else); a document whose text was null or blank before is kept as it is.

Null sites count as one site of their own. Repeated rows with one doc_id are treated alike: their
lines are the same. An empty table gives an empty result. Extra columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import materialize

MIN_SITES, MIN_CHARS, LG_K, BAND = 10, 20, 11, 4.0


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _norm(line):
    return F.trim(line)


def line_rows(docs: DataFrame, site: str, min_chars: int) -> DataFrame:
    """doc_id, pos (from 0), hash, site of each line that counts."""
    at = docs.select(
        "doc_id", F.coalesce(F.col(site).cast("string"), F.lit("\x00none")).alias("site"), F.posexplode(_lines(F.col("text")))
    )
    line = _norm(F.col("col"))
    return at.filter(F.length(line) >= min_chars).select(
        "doc_id", "pos", F.xxhash64(line).alias("hash"), "site"
    )


def spread(lines: DataFrame, min_sites: int, lg_k: int = LG_K, band: float = BAND) -> DataFrame:
    """hash, n_lines, n_sites, first (doc_id, pos) of each line on at least ``min_sites`` sites.
    n_sites is exact near the threshold and a rounded estimate above it."""
    error = 1.04 / math.sqrt(1 << lg_k)
    near = max(1.0, band * error * min_sites)
    counted = lines.groupBy("hash").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("est"),
        F.count(F.lit(1)).alias("n_lines"),
        F.min(F.struct("doc_id", "pos")).alias("first"),
    )
    likely = materialize(counted.filter(F.col("est") >= min_sites - near), "line-spread")
    unsure = likely.filter(F.col("est") <= min_sites + near).select("hash")
    exact = (
        lines.join(unsure, "hash", "left_semi")
        .select("hash", "site")
        .distinct()
        .groupBy("hash")
        .agg(F.count(F.lit(1)).alias("exact"))
    )
    return (
        likely.join(exact, "hash", "left")
        .withColumn("n_sites", F.coalesce("exact", "est"))
        .filter(F.col("n_sites") >= min_sites)
        .select("hash", "n_lines", "n_sites", "first")
    )


def _marked(docs: DataFrame, site: str, min_sites: int, min_chars: int, keep_first: bool) -> DataFrame:
    """doc_id, drop (array of line numbers) of each document that loses lines."""
    lines = line_rows(docs, site, min_chars)
    common = materialize(spread(lines, min_sites), "boilerplate")
    hits = lines.join(common.select("hash", "first"), "hash")
    if keep_first:
        hits = hits.filter(
            (F.col("doc_id") != F.col("first.doc_id")) | (F.col("pos") != F.col("first.pos"))
        )
    return hits.groupBy("doc_id").agg(F.collect_set("pos").alias("_fw_drop"))


def _removed(docs: DataFrame, drops: DataFrame) -> DataFrame:
    losing = docs.join(drops, "doc_id", "left").withColumn(
        "_fw_lines", F.when(F.col("_fw_drop").isNotNull(), _lines(F.col("text")))
    )
    # Numbers of the lines that stay, by hashing: linear in lines and drops.
    stay = F.array_except(F.sequence(F.lit(0), F.size("_fw_lines") - 1), F.col("_fw_drop"))
    kept = F.array_join(F.transform(stay, lambda i: F.get("_fw_lines", i)), "\n")
    return losing.withColumns(
        {"_fw_n": F.coalesce(F.size("_fw_drop"), F.lit(0)), "_fw_text": F.when(F.col("_fw_drop").isNull(), F.col("text")).otherwise(kept)}
    )


def strip_boilerplate(
    docs: DataFrame,
    site: str = "source",
    min_sites: int = MIN_SITES,
    min_chars: int = MIN_CHARS,
    keep_first: bool = True,
) -> DataFrame:
    """``docs`` with boilerplate lines removed from text, and lines_removed (long)."""
    out = _removed(docs, _marked(docs, site, min_sites, min_chars, keep_first))
    cols = [F.col("_fw_text").alias("text") if c == "text" else F.col(c) for c in docs.columns if c != "lines_removed"]
    return out.select(*cols, F.col("_fw_n").cast("long").alias("lines_removed"))


def clean(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` without boilerplate lines, and without documents that were nothing else."""
    out = _removed(docs, _marked(docs, site, min_sites, min_chars, True))
    gone = (F.col("_fw_n") > 0) & (F.length(F.trim(F.col("_fw_text"))) == 0)
    # n_chars describes the text, where the table has it.
    new = {"text": F.col("_fw_text"), "n_chars": F.length("_fw_text").cast("long")}
    return out.filter(~gone).select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Each document's number of lines removed, and its text afterwards as a digest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return strip_boilerplate(docs).select(
        "doc_id", "lines_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


LINES_SQL = r"""
WITH parts AS (SELECT doc_id, coalesce(source, chr(0) || 'none') AS site, string_split(coalesce(text, ''), chr(10)) AS ls FROM {docs}),
line_at AS (SELECT doc_id, site, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM parts),
common AS (
  SELECT trim(line) AS k, min((doc_id, pos)) AS first FROM line_at WHERE length(trim(line)) >= 20
  GROUP BY trim(line) HAVING count(DISTINCT site) >= 10),
kept AS (
  SELECT a.doc_id, a.pos, a.line, c.k IS NOT NULL AND (a.doc_id, a.pos) <> c.first AS gone
  FROM line_at a LEFT JOIN common c ON c.k = trim(a.line))
SELECT doc_id, CAST(count(*) FILTER (gone) AS BIGINT) AS lines_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM kept GROUP BY doc_id
"""
