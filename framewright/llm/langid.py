"""Operator 6, language identification in two levels.

Level one, one-versus-rest linear support vector machines over character n-grams choose the
language family. Level two, one-versus-one machines choose the language among those of that
family: each pair votes, equal votes go to the larger summed margin, then to the smaller name.

A text's features are the frequencies of its hashed n-grams of one to three characters, words
padded with spaces, letters lower-cased. A linear machine over frequencies is a mean of weights
over the text's n-grams, so a whole text of any length is scored by table lookups.

Training takes at most ``per_language`` labelled rows of each language and ``most`` in all (a
documented bound on the fit; every row is scored), chosen by a hash of doc_id at a rate that
follows from the language's row count. Executors return the n-gram frequencies of those rows, at
most 2**14 numbers each, not their texts. Texts of any length are worked through in slices. Only text and lang of rows that ``learn`` admits are used;
rows without lang teach nothing.

A text that is null or holds no letter gets ``und`` and score 0. Repeated rows get equal results.
An empty table, or one without labels, gives ``und`` everywhere. Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import crc_mod
from framewright.llm.textkit import SLICE, chunks

UNKNOWN = "und"
#: Families of closely related languages; a language not named here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "bg", "sr", "mk", "pl", "cs", "sk", "sl", "hr", "bs"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
}
BITS = 14
_M1, _M2, _M3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def ngrams(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashed n-grams of all texts, three rows by length; the text each belongs to; whether a
    text has a letter). Anything but letters acts as one blank."""
    low = [(t or "").lower() for t in texts]
    # Blanks follow each text, so that no n-gram reaches into the next one.
    code = np.frombuffer("".join(t + "   " for t in low).encode("utf-32-le", "surrogatepass") + b"\0" * 8, np.uint32)
    top = int(code.max(initial=0)) + 1
    kinds = np.unique(code)
    is_letter = np.zeros(top, bool)
    is_letter[[k for k in kinds.tolist() if chr(k).isalpha()]] = True
    letter = is_letter[code]
    code = np.where(letter, code, np.uint32(32))
    lengths = np.array([len(t) for t in low], np.int64)
    owner = np.repeat(np.arange(len(low)), lengths + 3)
    first = np.cumsum(lengths + 3) - lengths - 3
    at = np.flatnonzero(np.arange(len(owner)) - first[owner] <= lengths[owner])
    owner = owner[at]
    has = np.bincount(owner, weights=letter[at], minlength=len(low)) > 0
    a, b, c = code[at], code[at + 1], code[at + 2]
    one = a * _M1
    two = one ^ (b * _M2)
    three = two ^ (c * _M3)
    shift = np.uint32(32 - BITS)
    mix = lambda x: ((x ^ (x >> np.uint32(15))) * _M2) >> shift
    return np.stack([mix(one), mix(two ^ np.uint32(1)), mix(three ^ np.uint32(2))]), owner, has


def means(grams: np.ndarray, owner: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    """Mean weight of each text's n-grams: (n, machines)."""
    count = np.maximum(np.bincount(owner, minlength=n), 1)[:, None]
    out = np.zeros((n, weights.shape[1]))
    for k in range(weights.shape[1]):
        column = np.ascontiguousarray(weights[:, k])
        total = column[grams[0]] + column[grams[1]] + column[grams[2]]
        out[:, k] = np.bincount(owner, weights=total, minlength=n)
    return out / count


def in_slices(text: str | None) -> Iterator[tuple[np.ndarray, bool]]:
    """``ngrams`` of one text, slice by slice: the n-grams that begin in the slice, whether it has
    a letter."""
    low = (text or "").lower()
    for a in range(0, max(1, len(low)), SLICE):
        grams, _, has = ngrams([low[a : a + SLICE + 2]])  # n-grams reach two characters on
        yield grams if a + SLICE >= len(low) else grams[:, :SLICE], bool(has[0])


def frequencies(text: str | None) -> tuple[np.ndarray, bool]:
    """n-gram frequencies of a text, and whether it has a letter."""
    total, n, any_letter = np.zeros(1 << BITS, np.int64), 0, False
    for grams, has in in_slices(text):
        total += np.bincount(grams.ravel(), minlength=1 << BITS)
        n, any_letter = n + grams.shape[1], any_letter | has
    return (total / max(1, n)).astype(np.float32), any_letter


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """doc_id, lang, the n-grams that occur and their frequencies, of texts with a letter."""
    for pdf in batches:
        for a in range(0, len(pdf), 64):
            part = pdf.iloc[a : a + 64]
            made = [frequencies(t) for t in part["text"]]
            found = [np.flatnonzero(x) for x, _ in made]
            rows = part[["doc_id", "lang"]].assign(at=found, freq=[x[i] for (x, _), i in zip(made, found)])
            yield rows[[has for _, has in made]]


def train_svm(x: np.ndarray, y: np.ndarray, epochs: int = 60, reg: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine: squared hinge loss, classes weighted alike, full
    gradient steps with momentum."""
    w, b, vw, vb = np.zeros(x.shape[1], np.float32), 0.0, 0.0, 0.0
    each = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    rate = 0.5 / (float((each * (x * x).sum(1)).sum()) * 2 + reg + 1)
    for _ in range(epochs):
        slack = np.maximum(0, 1 - y * (x @ w + b)) * each * y
        vw = 0.9 * vw + 2 * (slack @ x) - reg * w
        vb = 0.9 * vb + 2 * float(slack.sum())
        w, b = w + rate * vw, b + rate * vb
    return w, b


class Model:
    """The machines' weights over n-gram frequencies, scaled so that margins near 1 are sure."""

    def __init__(self, x: np.ndarray, langs: list[str]) -> None:
        """x: a row of n-gram frequencies for each of langs."""
        self.langs = sorted(set(langs))
        family = [family_of(x) for x in langs]
        self.families = sorted(set(family))
        self.members = {f: [x for x in self.langs if family_of(x) == f] for f in self.families}
        self.pairs = [p for f in self.families for p in combinations(self.members[f], 2)]
        self.weights, self.bias = np.zeros((1 << BITS, 0), np.float32), np.zeros(0)
        if len(self.langs) < 2:
            return
        x = x.astype(np.float32)
        # Rare n-grams gain weight, and a typical row gets length 1.
        scale = 1 / np.sqrt(np.maximum(np.einsum("ij,ij->j", x, x) / len(x), 1e-6))
        x *= scale
        typical = float(np.median(np.sqrt(np.einsum("ij,ij->i", x, x))))
        x /= typical
        scale /= typical
        lang, fam = np.array(langs), np.array(family)
        made = []
        for f in self.families if len(self.families) > 1 else []:
            made.append(train_svm(x, np.where(fam == f, 1, -1).astype(np.float32)))
        for a, b in self.pairs:
            at = (lang == a) | (lang == b)
            made.append(train_svm(x[at], np.where(lang[at] == a, 1, -1).astype(np.float32)))
        if made:
            self.weights = np.stack([w * scale for w, _ in made], 1).astype(np.float32)
            self.bias = np.array([b for _, b in made])

    def predict(self, texts: list) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        if not self.langs:
            return [UNKNOWN] * n, np.zeros(n)
        if n == 1 and len(texts[0] or "") > SLICE:
            total, count, letter = 0.0, 0, False
            for grams, any_letter in in_slices(texts[0]):
                k = grams.shape[1]
                total = total + k * means(grams, np.zeros(k, np.int64), 1, self.weights)
                count, letter = count + k, letter | any_letter
            raw, has = total / max(1, count), np.array([letter])
        else:
            grams, owner, has = ngrams(texts)
            raw = means(grams, owner, n, self.weights)
        margin = raw + self.bias if raw.size else raw
        nf = len(self.families) if len(self.families) > 1 else 0
        best = margin[:, :nf].argmax(1) if nf else np.zeros(n, int)
        sure = 1 / (1 + np.exp(-4 * margin[np.arange(n), best])) if nf else np.ones(n)
        lang = np.empty(n, object)
        score = np.zeros(n)
        for k, f in enumerate(self.families):
            at = np.flatnonzero(best == k)
            members = self.members[f]
            votes, sums = np.zeros((len(at), len(members))), np.zeros((len(at), len(members)))
            for j, (a, b) in enumerate(self.pairs):
                if a in members:
                    m = margin[at, nf + j]
                    ia, ib = members.index(a), members.index(b)
                    votes[:, ia] += m > 0
                    votes[:, ib] += m <= 0
                    sums[:, ia] += m
                    sums[:, ib] -= m
            order = votes * 1e6 + sums
            pick = order.argmax(1)
            lang[at] = np.array(members, object)[pick]
            own = sums[np.arange(len(at)), pick] / max(1, len(members) - 1)
            score[at] = sure[at] * (1 / (1 + np.exp(-4 * own)) if len(members) > 1 else 1.0)
        lang[~has], score[~has] = UNKNOWN, 0.0
        return lang.tolist(), score


def fit(docs: DataFrame, learn: Column, per_language: int = 250, most: int = 2000) -> Model:
    """A model from at most ``per_language`` rows of each language and ``most`` in all."""
    rows = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model(np.zeros((0, 1 << BITS)), [])
    unit, per_language = 1 << 20, max(1, min(per_language, most // len(counts)))
    draw = F.pmod(F.xxhash64(F.lit(7), F.col("doc_id")), F.lit(unit))
    keep = F.lit(False)
    for lang, n in counts.items():
        keep = keep | ((F.col("lang") == lang) & (draw < int(min(1.0, 1.2 * per_language / n + 1e-6) * unit) + 1))
    ident = docs.schema["doc_id"].dataType.simpleString()
    sample = (
        rows.filter(keep).select("doc_id", "lang", "text")
        .mapInPandas(_frequencies, f"doc_id {ident}, lang string, at array<int>, freq array<float>")
        .collect()
    )
    x, langs, had = [], [], dict.fromkeys(counts, 0)
    for r in sorted(sample, key=lambda r: (r["doc_id"] is None, r["doc_id"])):
        if had[r["lang"]] < per_language:
            had[r["lang"]] += 1
            langs.append(r["lang"])
            x.append(np.zeros(1 << BITS, np.float32))
            x[-1][r["at"]] = r["freq"]
    return Model(np.array(x).reshape(len(langs), 1 << BITS), langs)


def _score(batches: Iterator[pd.DataFrame], shared, lang: str, score: str) -> Iterator[pd.DataFrame]:
    model = shared.value
    for pdf in batches:
        texts = list(pdf["text"])
        langs, scores = [], [np.zeros(0)]
        for a, b in chunks(texts, 1 << 19):
            found, sure = model.predict(texts[a:b])
            langs += found
            scores.append(sure)
        pdf[lang], pdf[score] = langs, np.concatenate(scores)
        yield pdf


def learn_rule() -> Column:
    """Rows to learn from: those whose crc32 modulo 3 is not 1."""
    return crc_mod("doc_id", 3) != 1


def identify(docs: DataFrame, model: Model, lang: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """``docs`` with the predicted language and its score under these names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.withColumns({lang: F.lit(""), score: F.lit(0.0)}).schema
    return docs.mapInPandas(lambda it: _score(it, shared, lang, score), schema)


def reject(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """``docs`` without texts of no language (``und``) and without those whose score is under
    ``least``: no learned language fits them."""
    found = identify(docs, fit(docs, learn_rule()), "_fw_lang", "_fw_score")
    return found.filter((F.col("_fw_lang") != UNKNOWN) & (F.col("_fw_score") >= least)).select(*docs.columns)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs, learn_rule())
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id",
        (crc_mod("doc_id", 3) == 1).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
    )
