"""Operator 9, exact top-k search by pivot-table elimination.

Components become floor(64 * x); the score is the integer inner product. With one more
coordinate sqrt(M - |c|^2) on every candidate (M the greatest squared length), the inner product
orders candidates as the distance to the query does: d^2 = |q|^2 + M - 2 q.c. Every candidate's
distances to a few dozen pivots are computed once for each block; by the triangle inequality the
greatest difference between a query's and a candidate's pivot distances bounds their distance
from below. Queries take candidates in order of that bound and stop when the next bound exceeds
their k-th best distance, so the result is exact. A k-th distance known from the pivots' own sample
makes the first block stop early too. How much is left out depends on the data: vectors spread
evenly over a sphere of many dimensions leave nearly all to be scored, clusters leave few.

Pivots are chosen farthest-first from a bounded sample. The query set (a stated share of the
rows) is dealt into blocks of about ``block`` queries. The blocks run in turn, each against all
rows: the driver reads one block, sends it to the tasks, stores its results and drops it, so
neither driver nor tasks ever hold more than one block. Every task returns its k best for each
query; those meet in an aggregation over the query's key.

Vectors that are null or hold a null or a component that is not finite take no part. All others
do; an inner product needs equal lengths, so each length that occurs is searched by itself. Scores are exact: while the greatest squared
length is under 2**53, products are taken in doubles, else in 64-bit integers; a table on
which a score might exceed 64 bits is refused. Equal scores go to the smaller vec_id, repeated
vectors are candidates each; vec_id names one row. With fewer than k candidates all are returned.
Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.common import materialize

SCALE = 64
CELLS = 1 << 20  # components of candidates that a task holds at a time


def valid(df: DataFrame) -> DataFrame:
    """vec_id, v: the rows that take part, components as doubles."""
    v = F.col("embedding").cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return (
        df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
        .filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad))
    )


def quantized(rows, dim: int) -> np.ndarray:
    """floor(64 x) as doubles, which hold it without error."""
    return np.floor(SCALE * np.array(rows, np.float64).reshape(len(rows), dim))


def distances(a: np.ndarray, a2: np.ndarray, b: np.ndarray, b2: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(a2[:, None] + b2[None, :] - 2 * (a @ b.T), 0))


class Pivots:
    """Pivot vectors with their extra coordinate, and the bound M on squared lengths."""

    def __init__(self, sample: np.ndarray, top: float, n: int) -> None:
        self.top = top
        ext = self.extended(sample)
        n2 = (ext * ext).sum(1)
        near = np.full(len(ext), np.inf)
        chosen = []
        nxt = 0
        for _ in range(min(n, len(ext))):
            chosen.append(nxt)
            near = np.minimum(near, distances(ext, n2, ext[[nxt]], n2[[nxt]])[:, 0])
            nxt = int(near.argmax())
            if near[nxt] == 0:
                break
        self.at = ext[chosen]
        self.n2 = n2[chosen]

    def extended(self, v: np.ndarray) -> np.ndarray:
        return np.hstack([v, np.sqrt(np.maximum(self.top - (v * v).sum(1), 0))[:, None]])

    def table(self, ext: np.ndarray) -> np.ndarray:
        return distances(ext, (ext * ext).sum(1), self.at, self.n2)


def search_block(q_ids, q, start, ids, c, pivots: Pivots, k: int, group: int = 64, strip: int = 2048):
    """Each query's k best of one block of candidates. start: a score that k candidates reach; its
    type, double or 64-bit integer, is that of all scores.

    Queries go in groups of near ones, so that one order of candidates by their bound serves a
    group, and strips of that order are scored by one matrix product."""
    rows = pivots.table(pivots.extended(c)).astype(np.float32).T.copy()
    columns = pivots.table(np.hstack([q, np.zeros((len(q), 1))])).astype(np.float32)
    q2 = (q * q).sum(1)
    # Room for rounding in the bounds, relative to the lengths at hand.
    slack = 1e-3 + 1e-5 * float(np.sqrt(pivots.top + q2.max(initial=0)))
    reach_of = lambda j, score: np.sqrt(np.maximum(0.0, q2[j] + pivots.top - 2.0 * score)) + slack
    near = np.lexsort((columns.min(1), columns.argmin(1)))
    q, c = q.astype(start.dtype), c.astype(start.dtype)
    out: list = []
    for a in range(0, len(q), group):
        j = near[a : a + group]
        low = np.zeros((len(j), len(c)), np.float32)
        for p in range(len(rows)):
            np.maximum(low, np.abs(rows[p][None, :] - columns[j, p][:, None]), out=low)
        least = low.min(0)
        order = np.argsort(least, kind="stable")
        kth = start[j].copy()
        reach = reach_of(j, kth)
        best = (np.zeros(0, np.int64), np.zeros(0, start.dtype), np.zeros(0, np.int64))
        for b in range(0, len(c), strip):
            at = order[b : b + strip]
            if least[at[0]] > reach.max():
                break  # no candidate further on can reach any query of the group
            score = c[at] @ q[j].T
            x, y = np.nonzero((score >= kth[None, :]) & (low[:, at].T <= reach[None, :]))
            other = ids[at[x]] != q_ids[j[y]]
            x, y = x[other], y[other]
            row = np.concatenate([best[0], y])
            value = np.concatenate([best[1], score[x, y]])
            who = np.concatenate([best[2], ids[at[x]]])
            by = np.lexsort((who, -value, row))
            row, value, who = row[by], value[by], who[by]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            keep = place < k
            best = (row[keep], value[keep], who[keep])
            full = place == k - 1
            kth[row[full]] = np.maximum(kth[row[full]], value[full])
            reach = reach_of(j, kth)
        out.append((q_ids[j[best[0]]], best[2], best[1].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def _search(batches: Iterator[pd.DataFrame], shared, k: int) -> Iterator[pd.DataFrame]:
    q_ids, q, start, pivots, dim = shared.value
    held: list = []
    count = 0

    def run(parts):
        ids = np.concatenate([p[0] for p in parts])
        c = np.concatenate([p[1] for p in parts])
        a, b, s = search_block(q_ids, q, start, ids, c, pivots, k)
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": s})

    for pdf in batches:
        most = max(1, CELLS // max(1, dim))  # a few MB of vectors at a time
        for a in range(0, len(pdf), most):
            part = pdf.iloc[a : a + most]
            held.append((part["vec_id"].to_numpy(), quantized(part["v"].to_list(), dim)))
            count += len(part)
            if count >= most:
                yield run(held)
                held, count = [], 0
    if held:
        yield run(held)


def search(
    vectors: DataFrame, is_query: Column, k: int = 20, pivots: int = 32, sample: int = 2048, block: int = 4096
) -> DataFrame:
    """query_id, rank, vec_id, score over the rows of ``vectors`` (vec_id, embedding)."""
    rows = valid(vectors)
    floors = F.transform("v", lambda x: F.floor(x * SCALE).cast("double"))
    facts = rows.groupBy(F.size("v").alias("dim")).agg(
        F.max(F.aggregate(floors, F.lit(0.0), lambda s, x: s + x * x)).alias("top"),
        F.count(F.when(is_query, 1)).alias("n"),
    )
    out = [
        found
        for f in sorted(facts.filter("n > 0").collect())
        for found in _search_length(rows.filter(F.size("v") == f["dim"]), is_query, f, k, pivots, sample, block)
    ]
    if not out:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(DataFrame.unionByName, out)


def _search_length(rows: DataFrame, is_query: Column, facts, k: int, pivots: int, sample: int, block: int) -> list[DataFrame]:
    """The results of each block of queries among vectors of one length."""
    spark, dim, most = rows.sparkSession, facts["dim"], facts["top"]  # no partial sum exceeds the greatest square
    if most >= 2.0**63:
        raise ValueError("scores of these vectors may exceed 64 bits")
    kind = np.float64 if most < 2.0**53 else np.int64
    none = -np.inf if kind is np.float64 else np.iinfo(np.int64).min
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    ground, ground_ids = quantized([r["v"] for r in drawn], dim), np.array([r["vec_id"] for r in drawn])
    table = Pivots(ground, float(facts["top"]), pivots)
    n_blocks = -(-int(facts["n"]) * 5 // (4 * block)) if facts["n"] > block else 1
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = []
    for b in range(n_blocks):
        mine = rows.filter(is_query & (F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_blocks)) == b)).collect()
        if not mine:
            continue
        q_ids, q = np.array([r["vec_id"] for r in mine]), quantized([r["v"] for r in mine], dim)
        # The k-th best score in the sample: at least k candidates reach it.
        start = np.full(len(q), none, kind)
        if len(ground) > k:
            for a in range(0, len(q), 256):
                s = q[a : a + 256].astype(kind) @ ground.T.astype(kind)
                s[q_ids[a : a + 256, None] == ground_ids[None, :]] = none
                start[a : a + 256] = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        shared = spark.sparkContext.broadcast((q_ids, q, start, table, dim))
        found = (
            rows.mapInPandas(lambda it, shared=shared: _search(it, shared, k), "query_id long, vec_id long, score long")
            .withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        )
        if n_blocks > 1:
            found = materialize(found, "nearest")
            shared.destroy()
        out.append(found)
    return out


def op9_topk_search(spark, sf_dir: str) -> DataFrame:
    """The 20 best of all embeddings for every row whose vec_id is divisible by 20."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s)
SELECT query_id, CAST(rn AS INTEGER) AS rank, vec_id, score FROM r WHERE rn <= 20
"""
