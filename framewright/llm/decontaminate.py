"""Operator 8, benchmark decontamination with suffix arrays of the training text.

Each batch of documents is a shard. Words become the numbers of the benchmark's vocabulary, any
other word becomes 0. A match holds benchmark words only, so the shard's suffix array needs only
suffixes that begin a run of such words as long as the shortest window: this leaves out no
match, and leaves few suffixes. The array is sorted by the first ``window`` words. Every suffix
of every test item is binary-searched in it; the range found holds all places where that window
occurs, and consecutive finds along one diagonal make up the longest verbatim matches.

The benchmark travels to the tasks in blocks of at most ``block_words`` words (a bound of a few MB
each), one block at a time: the driver builds a block from rows that come to it a partition at a
time, the tasks search it, and before the next one what was found is stored beside the documents
and the block is dropped. So neither driver nor tasks hold more than a block or two, whatever the
benchmark's size; a benchmark of one block is one pass. Documents are never shuffled: a passage that
every document holds costs no more than another.

A long text is read a slice at a time; beside itself it adds a few 8-byte numbers a word. Null and empty texts have no words and no hits; items without words are never found; repeated
documents and repeated items count each for themselves (two items with one text are two items;
equal item_ids count once). Extra columns pass through ``matches`` and ``flag``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm.common import materialize, release
from framewright.llm.textkit import SLICE, chunks

#: Bytes that separate words; upper-case ASCII becomes lower case.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
WINDOW = 10


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def numbers(text: str | None, vocab: dict[bytes, int]) -> np.ndarray:
    """The words' numbers, 0 for words not in the vocabulary; a long text a slice at a time."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)
    get, out, a = vocab.get, [np.zeros(0, np.int64)], 0
    while a < len(raw):
        b = raw.find(b" ", a + SLICE) if a + SLICE < len(raw) else -1
        b = len(raw) if b < 0 else b
        words = raw[a:b].split()
        out.append(np.fromiter((get(x, 0) for x in words), np.int64, len(words)))
        a = b
    return np.concatenate(out)


class Block:
    """A part of the benchmark: vocabulary, window keys and their owners."""

    def __init__(self, items: list[tuple[int, str]], window: int) -> None:
        self.window, self.vocab, keys = window, {}, []
        self.shortest = 1 << 30
        self.item_of, self.text_of, self.at = [], [], []
        for number, (item, text) in enumerate(items):
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            if not ids:
                continue
            n = min(window, len(ids))
            self.shortest = min(self.shortest, n)
            for j in range(len(ids) - n + 1):
                keys.append(ids[j : j + n] + [0] * (window - n))
                self.item_of.append(item)
                self.text_of.append(number)
                self.at.append(j)
        self.item_of, self.text_of, self.at = (np.array(x, np.int64) for x in (self.item_of, self.text_of, self.at))
        rows = np.array(keys, ">u4").reshape(len(keys), window)
        self.length = (rows > 0).sum(1)
        self.low = packed(rows)
        high = rows.copy()
        high[rows == 0] = 0xFFFFFFFF
        self.high = packed(high)


def packed(rows: np.ndarray) -> np.ndarray:
    """Rows of big-endian numbers as byte strings that sort alike."""
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1] * 4}").ravel()


def shard_hits(texts: list, block: Block) -> tuple[np.ndarray, list, np.ndarray, np.ndarray]:
    """(number of words of each text, its first word's place, places hit, window found there),
    the last two sorted by place; places count over the whole shard, texts lie one apart."""
    each = [numbers(t, block.vocab) for t in texts]
    counts = np.array([len(w) for w in each], np.int64)
    first = np.zeros(len(each) + 1, np.int64)
    np.cumsum(counts + 1, out=first[1:])
    ids = np.zeros(first[-1] + block.window, np.int64)
    for w, a in zip(each, first):
        ids[a : a + len(w)] = w
    # Words that follow without a gap, the word itself included.
    gap = np.flatnonzero(ids == 0)
    run = gap[np.searchsorted(gap, np.arange(len(ids)))] - np.arange(len(ids))
    start = np.flatnonzero(run >= block.shortest) if len(block.at) else np.zeros(0, np.int64)
    if not len(start):
        return counts, first, start, start
    rows = ids[start[:, None] + np.arange(block.window)]
    rows[np.arange(block.window) >= run[start][:, None]] = 0
    keys = packed(rows.astype(">u4"))
    order = np.argsort(keys, kind="stable")
    suffixes, keys = start[order], keys[order]
    lo = np.searchsorted(keys, block.low, "left")
    hi = np.searchsorted(keys, block.high, "right")
    n = np.maximum(hi - lo, 0)
    which = np.repeat(np.arange(len(n)), n)
    place = suffixes[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
    by = np.lexsort((which, place))
    return counts, first, place[by], which[by]


def longest_matches(first: np.ndarray, place: np.ndarray, which: np.ndarray, block: Block) -> dict[str, np.ndarray]:
    """Maximal verbatim matches, from finds that follow each other along one diagonal: document,
    item, first word in either, number of words."""
    doc = np.searchsorted(first, place, "right") - 1
    text, at = block.text_of[which], block.at[which]
    by = np.lexsort((place, place - at, text, doc))
    doc, text, at, place, which = (x[by] for x in (doc, text, at, place, which))
    new = np.ones(len(doc), bool)
    new[1:] = (np.diff(doc) != 0) | (np.diff(text) != 0) | (np.diff(place - at) != 0) | (np.diff(place) != 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(doc)) - 1 if len(head) else head
    return {
        "doc": doc[head], "item_id": block.item_of[which[head]], "doc_word": place[head] - first[doc[head]],
        "item_word": at[head], "n_words": place[tail] + block.length[which[tail]] - place[head],
    }


def _blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[Block]:
    """The benchmark as blocks; one partition's rows at a time come to the driver."""
    part, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), "text").filter("item_id is not null").toLocalIterator():
        n = len(words_of(r["text"]))
        if part and size + n > block_words:
            yield Block(part, window)
            part, size = [], 0
        part.append((r["item_id"], r["text"]))
        size += n
    yield Block(part, window)


def _scan(batches: Iterator[pd.DataFrame], shared) -> Iterator[pd.DataFrame]:
    block = shared.value
    for pdf in batches:
        texts = list(pdf["text"])
        ranges, items, best = list(pdf["_fw_ranges"]), list(pdf["_fw_items"]), list(pdf["_fw_longest"])
        total = np.zeros(len(texts), np.int64)
        for a, b in chunks(texts, 4 << 20):
            counts, first, place, which = shard_hits(texts[a:b], block)
            total[a:b] = counts
            cut = np.searchsorted(place, first)
            for i in np.flatnonzero(np.diff(cut)):
                p, w = place[cut[i] : cut[i + 1]] - first[i], which[cut[i] : cut[i + 1]]
                spans = np.unique(np.stack([p, p + block.length[w]], 1), axis=0)
                ranges[a + i] = merged([*decoded(ranges[a + i]), *map(tuple, spans)])
                items[a + i] = sorted({*map(int, items[a + i]), *np.unique(block.item_of[w]).tolist()})
            found = longest_matches(first, place, which, block)
            # The longest, then the first in the document, then the smallest item.
            for i, at, item, n in sorted(zip(*(found[c].tolist() for c in ("doc", "doc_word", "item_id", "n_words")))):
                if not len(best[a + i]) or (n, -at, -item) > (best[a + i][0], -best[a + i][1], -best[a + i][2]):
                    best[a + i] = [n, at, item]
        pdf["_fw_words"], pdf["_fw_ranges"], pdf["_fw_items"], pdf["_fw_longest"] = total, ranges, items, best
        yield pdf


def decoded(flat) -> list[tuple[int, int]]:
    return list(zip(map(int, flat[::2]), map(int, flat[1::2])))


def merged(spans: list[tuple[int, int]]) -> list[int]:
    """The union of half-open spans, as start, end, start, end, ..."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], int(b))
        else:
            out += [int(a), int(b)]
    return out


def flag(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = 2_000_000) -> DataFrame:
    """``docs`` with decon_words (long), decon_ranges (array of start, end, ... in words),
    decon_items (array<long>, sorted) and decon_longest (words of the longest verbatim match, its
    first word in the document, its item; empty without a match)."""
    made = {"decon_words": "_fw_words", "decon_ranges": "_fw_ranges", "decon_items": "_fw_items", "decon_longest": "_fw_longest"}
    keep = [c for c in docs.columns if c not in made]
    return _flagged(docs, benchmark, window, block_words).select(*keep, *[F.col(c).alias(n) for n, c in made.items()])


def _flagged(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int) -> DataFrame:
    spark, none = docs.sparkSession, F.array().cast("array<long>")
    df = docs.withColumns({"_fw_words": F.lit(0).cast("long"), "_fw_ranges": none, "_fw_items": none, "_fw_longest": none})
    shared = stored = None
    for block in _blocks(benchmark, window, block_words):
        if shared is not None:
            before, stored = stored, materialize(df, "decontamination")
            shared.destroy()
            if before is not None:
                release(spark, before)
            df = stored
        shared = spark.sparkContext.broadcast(block)
        df = df.mapInPandas(lambda it, shared=shared: _scan(it, shared), df.schema)
    return df


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = 2_000_000) -> DataFrame:
    """``docs`` without those that hold a window of a benchmark item."""
    found = _flagged(docs, benchmark, window, block_words)
    return found.filter(F.size("_fw_items") == 0).select(*docs.columns)


def _longest(batches: Iterator[pd.DataFrame], shared) -> Iterator[pd.DataFrame]:
    block = shared.value
    for pdf in batches:
        texts, ids = list(pdf["text"]), pdf["doc_id"].to_numpy()
        for a, b in chunks(texts, 4 << 20):
            _, first, place, which = shard_hits(texts[a:b], block)
            found = longest_matches(first, place, which, block)
            yield pd.DataFrame({"doc_id": ids[a + found.pop("doc")], **found})


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = 2_000_000) -> DataFrame:
    """Every maximal verbatim match of ``window`` words or more (whole items where shorter):
    doc_id, item_id, its first word in either, its length in words."""
    sc = docs.sparkSession.sparkContext
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType)]
        + [T.StructField(c, T.LongType()) for c in ("item_id", "doc_word", "item_word", "n_words")]
    )
    out = []
    for block in _blocks(benchmark, window, block_words):
        shared = sc.broadcast(block)
        part = docs.select("doc_id", "text").mapInPandas(lambda it, shared=shared: _longest(it, shared), schema)
        out.append(materialize(part, "matches"))
        shared.destroy()
    return reduce(DataFrame.unionByName, out)


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = flag(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text")
    ends = F.col("decon_ranges")
    hit = F.aggregate(
        F.transform(ends, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda s, x: s + x
    )
    ids = F.array_join(F.array_sort(F.transform("decon_items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id",
        F.col("decon_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("decon_items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        (F.size("decon_items") > 0).alias("contaminated"),
        F.coalesce(F.get("decon_longest", F.lit(0)), F.lit(0).cast("long")).alias("longest_words"),
        F.get("decon_longest", F.lit(1)).alias("longest_at"),
        F.get("decon_longest", F.lit(2)).alias("longest_item"),
    )


DECON_SQL = r"""
WITH dw AS (
  SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM (
    SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM {docs}))),
bl AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[j : j + least(len(ws), 10) - 1], ' ') AS k FROM (
    SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS j FROM bl WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dwin AS (
  SELECT doc_id, pos, n, array_to_string(list(w) OVER (PARTITION BY doc_id, n ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)[1:n], ' ') AS k,
         count(*) OVER (PARTITION BY doc_id, n ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS got
  FROM dw, lens),
hits AS (SELECT DISTINCT d.doc_id, d.pos, d.n, w.item_id FROM dwin d JOIN win w ON d.n = w.n AND d.k = w.k),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_words FROM dw GROUP BY doc_id),
texts AS (SELECT item_id, ws, row_number() OVER () AS b FROM bl WHERE len(ws) > 0),
wpos AS (
  SELECT b, item_id, j, least(len(ws), 10) AS n, array_to_string(ws[j : j + least(len(ws), 10) - 1], ' ') AS k FROM (
    SELECT b, item_id, ws, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS j FROM texts)),
along AS (
  SELECT d.doc_id, d.pos, w.b, w.item_id, w.n, d.pos - w.j AS diagonal,
         d.pos - row_number() OVER (PARTITION BY d.doc_id, w.b, d.pos - w.j ORDER BY d.pos) AS run
  FROM dwin d JOIN wpos w ON d.n = w.n AND d.k = w.k),
runs AS (SELECT doc_id, item_id, min(pos) - 1 AS began, max(pos) - min(pos) + n AS words FROM along GROUP BY doc_id, b, item_id, n, diagonal, run),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, began, item_id) AS r FROM runs)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(words, 0) AS BIGINT) AS longest_words,
       CAST(began AS BIGINT) AS longest_at, CAST(best.item_id AS BIGINT) AS longest_item
FROM {docs} d LEFT JOIN n USING (doc_id) LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)
LEFT JOIN best ON best.doc_id = d.doc_id AND best.r = 1
"""
