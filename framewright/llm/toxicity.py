"""Operator 10, toxicity by a factorization machine over hashed terms.

A text's features are the hashed terms it holds (each once): lower-cased words. The score is
  w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)
through a logistic function, so pairs of terms that together mean more than each alone (an
insult and the mention of a group) get weight of their own.

Fit: at most ``rows`` labelled rows (a documented bound on the fit; every row is scored), drawn by
a hash of doc_id at a rate that follows from the number of labels. Executors return the hashed
terms of those rows, not their texts. Terms that occur in too few of them, or tell nothing about
the label by chi-square, get no weight; the rest (at most ``terms``) are learned by Adagrad with
classes weighted alike, and the bias is set where the learned rows' F1 is best.

Null and empty texts have no terms and get the bias alone. Without labels, or with only one
class, every score is that class's share (0 without labels). Repeated rows get equal results.
Extra columns pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import crc_mod

BITS = 20
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 or 48 <= b <= 57 else 32 for b in range(256))


def terms_of(text: str | None) -> set[bytes]:
    return set((text or "").lower().encode("utf-8", "surrogatepass").translate(_TABLE).split())


class Hasher:
    """crc32 buckets of terms, remembered up to a bound."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, term: bytes) -> int:
        at = self.known.get(term)
        if at is None:
            at = zlib.crc32(term) >> (32 - BITS)
            if len(self.known) < 200_000:
                self.known[term] = at
        return at


class Machine:
    """The learned terms' buckets (sorted), weights and factors."""

    def __init__(self, prior: float = 0.0) -> None:
        p = min(max(prior, 1e-6), 1 - 1e-6)
        self.bias = float(np.log(p / (1 - p)))
        self.buckets = np.zeros(0, np.int64)
        self.w = np.zeros(0)
        self.v = np.zeros((0, 0))
        self.scale = 1.0

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        """Scores before the logistic; rows: positions of learned terms."""
        n = len(rows)
        owner = np.repeat(np.arange(n), [len(r) for r in rows])
        at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        add = lambda x: np.bincount(owner, weights=x, minlength=n)
        out = self.bias + add(self.w[at])
        for f in range(self.v.shape[1]):
            v = self.v[at, f]
            out += 0.5 * (add(v) ** 2 - add(v * v))
        return out

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows), -30, 30)))

    def learn(self, rows: list[np.ndarray], y: np.ndarray, factors: int, epochs: int, reg: float) -> None:
        n, d = len(rows), len(self.buckets)
        rng = np.random.default_rng(0)
        self.w, self.v = np.zeros(d), rng.normal(0, 0.05, (d, factors))
        owner = np.repeat(np.arange(n), [len(r) for r in rows])
        at = np.concatenate(rows)
        weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * n
        gw, gv, gb = np.full(d, 1e-2), np.full((d, factors), 1e-2), 1e-2
        bound = np.array_split(np.arange(n), max(1, n // 512))
        spans = np.searchsorted(owner, [b[0] for b in bound] + [n])
        for _ in range(epochs):
            for k in rng.permutation(len(bound)):
                rows_k, a = bound[k], at[spans[k] : spans[k + 1]]
                o = owner[spans[k] : spans[k + 1]] - rows_k[0]
                m = len(rows_k)
                add = lambda x: np.bincount(o, weights=x, minlength=m)
                sums = np.stack([add(self.v[a, f]) for f in range(factors)], 1)
                raw = self.bias + add(self.w[a]) + 0.5 * sum(
                    sums[:, f] ** 2 - add(self.v[a, f] ** 2) for f in range(factors)
                )
                err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[rows_k]) * weight[rows_k] / m
                db = float(err.sum())
                dw = np.bincount(a, weights=err[o], minlength=d) + reg * self.w
                gb += db * db
                gw += dw * dw
                self.bias -= 0.3 * db / np.sqrt(gb)
                self.w -= 0.3 * dw / np.sqrt(gw)
                for f in range(factors):
                    dv = np.bincount(a, weights=err[o] * (sums[o, f] - self.v[a, f]), minlength=d) + reg * self.v[:, f]
                    gv[:, f] += dv * dv
                    self.v[:, f] -= 0.1 * dv / np.sqrt(gv[:, f])
        # The bias moves to where F1 over the learned rows is best.
        raw = self.raw(rows)
        order = np.argsort(-raw, kind="stable")
        hit = np.cumsum(y[order])
        f1 = 2 * hit / (np.arange(1, n + 1) + y.sum())
        cut = int(f1.argmax())
        edge = raw[order[cut]]
        under = raw[order[cut + 1]] if cut + 1 < n else edge - 1
        self.bias -= (edge + under) / 2

    def pick(self, buckets: np.ndarray) -> np.ndarray:
        """Positions of those buckets that are learned."""
        if not len(self.buckets):
            return np.zeros(0, np.int64)
        at = np.searchsorted(self.buckets, buckets)
        at[at == len(self.buckets)] = 0
        return np.unique(at[self.buckets[at] == buckets])


def train(rows: list[np.ndarray], y: np.ndarray, terms: int = 4096, factors: int = 4, epochs: int = 40, reg: float = 1e-4) -> Machine:
    """A machine from bucket arrays (each bucket once) and labels 0 or 1."""
    m = Machine(float(y.mean()) if len(y) else 0.0)
    if not len(y) or y.min() == y.max():
        return m
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    both = np.bincount(flat, minlength=1 << BITS).astype(float)
    ones = np.bincount(flat, weights=y[owner], minlength=1 << BITS)
    n, n1 = len(y), float(y.sum())
    want = both * n1 / n
    spread = want * (1 - n1 / n) * (1 - both / n)
    chi = np.where((both >= 3) & (spread > 0), (ones - want) ** 2 / np.maximum(spread, 1e-12), 0)
    best = np.argsort(-chi, kind="stable")[:terms]
    m.buckets = np.sort(best[chi[best] > 6.6])
    if not len(m.buckets):
        return m
    m.learn([m.pick(np.unique(r)) for r in rows], y.astype(float), factors, epochs, reg)
    return m


def _buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hasher = Hasher()
    for pdf in batches:
        made = [np.unique(np.fromiter(map(hasher, terms_of(t)), np.int64)).tolist() for t in pdf["text"]]
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "buckets": made})


def fit(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = 8000) -> Machine:
    """A machine from at most about ``rows`` labelled documents; ``learn`` is over doc_id."""
    use = labels.filter(learn & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select("doc_id", "toxic")
    n = use.count()
    unit = 1 << 20
    rate = int(min(1.0, rows / max(n, 1)) * unit) + 1
    drawn = use.filter(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(unit)) < rate)
    sample = (
        docs.select("doc_id", "text")
        .join(F.broadcast(drawn), "doc_id")  # about ``rows`` rows by the rate above
        .select("doc_id", "toxic", "text")
        .mapInPandas(_buckets, "doc_id long, toxic int, buckets array<int>")
        .collect()
    )
    sample.sort(key=lambda r: (r["doc_id"], r["toxic"]))
    return train(
        [np.array(r["buckets"], np.int64) for r in sample], np.array([r["toxic"] for r in sample], np.int64)
    )


def _score(batches: Iterator[pd.DataFrame], shared) -> Iterator[pd.DataFrame]:
    machine = shared.value
    hasher = Hasher()
    learned = {int(b) for b in machine.buckets}
    for pdf in batches:
        rows = []
        for t in pdf["text"]:
            found = {h for h in map(hasher, terms_of(t)) if h in learned}
            rows.append(machine.pick(np.fromiter(found, np.int64, len(found))))
        pdf["toxicity"] = machine.score(rows)
        yield pdf


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """``docs`` with the column toxicity."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    schema = docs.withColumn("toxicity", F.lit(0.0)).schema
    return docs.mapInPandas(lambda it: _score(it, shared), schema)


def learn_rule() -> Column:
    """Rows to learn from: those whose crc32 modulo 5 is not 0."""
    return crc_mod("doc_id", 5) != 0


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    machine = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn_rule())
    return score(docs, machine).select(
        "doc_id",
        (crc_mod("doc_id", 5) == 0).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )
