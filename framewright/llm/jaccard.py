"""Operator 7, n-gram Jaccard join with parity sketches.

A document is the set of its word shingles. Documents with one set are one class (by a hash of
the whole set), so exact copies cost one row each from there on.

Sketch: shingles fall by hash into the parts of their size band; a part's word is the XOR of its
shingles' hashes. A shingle in which two sets differ changes one word at most, so the number of
words in which two sketches differ is at most the symmetric difference of the sets. Sets of sizes
a and b with Jaccard similarity t or more differ in at most d = (1-t)/(1+t) * (a+b) shingles.

Pigeonhole join: give the non-empty words one order for all documents. Among a set's first
d + 1 + s words at least 1 + s are untouched by the difference and lie among the other set's
first d + 1 + s as well: so every pair to be found shares 1 + s of the words that both emit.
Size bands [12^k, 16*12^k) overlap so that any pair of sizes within ratio t meets in one band.
Words of shingles that very many documents hold come last in that order (their choice, by a
frequency summary of all documents, changes the work only, never the result), so a passage that
a third of all documents share makes no candidates.

Links: for the component of each document it is enough to know a spanning set of links. In rounds,
each class is verified against one class that shares most words with it, among leaders of its word
groups; then all pairs of classes that share 1 + s words, still lie in different components and
whose 1024-bit parity sketches (whose Hamming distance is a lower bound again) lie within d are
verified. No pair that may link is left out.

Texts are worked through a slice at a time; what a text adds beside itself is 8 bytes a word, and a
set of shingles, 8 bytes each. Hashes have 64 bits. Null or empty texts and texts without words have no shingles and link with
nothing; shorter texts have one shingle. Rows without doc_id take no part; doc_id names one
document, repeated rows count once. Extra columns are ignored. Similarity must be at least 0.75.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm.common import materialize, release, small_batches
from framewright.llm.graph import ONE_TASK, components
from framewright.llm.textkit import Powers, mix64, shingles

SIZE, NUM, DEN = 5, 75, 100
SUMMARY, FOLD, OFTEN, MOST_FREQUENT = 50_000, 1 << 20, 5000, 200_000
STEP, RATIO = 12, 16  # a band's start over the last one's, and its end over its start: RATIO/STEP is 1/t
SPARE, SKETCH = 32, 1024
PASSES, ROUNDS, FEW, REMEMBERED, SMALL = 2, 3, 8, 1 << 20, 8


def most_apart(a: int, b: int) -> int:
    """The largest symmetric difference of sets of these sizes that link."""
    return (DEN - NUM) * (a + b) // (DEN + NUM)


def spare(n: int) -> int:
    """Words that a set emits beyond the pigeonhole's need."""
    return n // SPARE


def emitted(n: int) -> int:
    return most_apart(n, n * DEN // NUM) + 1 + spare(n)


class Frequent:
    """Misra-Gries summary of the most frequent shingles of a partition."""

    def __init__(self, room: int) -> None:
        self.room, self.parts = room, []
        self.keys, self.counts, self.held = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0

    def add(self, hashes: np.ndarray) -> None:
        self.parts.append(hashes)
        self.held += len(hashes)
        if self.held > FOLD:
            self.fold()

    def fold(self) -> None:
        new, count = np.unique(np.concatenate(self.parts), return_counts=True) if self.parts else (self.keys[:0], self.counts[:0])
        keys, at = np.unique(np.concatenate([self.keys, new]), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([self.counts, count]), minlength=len(keys)).astype(np.int64)
        if len(keys) > self.room:
            counts -= np.partition(counts, len(counts) - self.room - 1)[len(counts) - self.room - 1]
        self.keys, self.counts = keys[counts > 0], counts[counts > 0]
        self.parts, self.held = [], 0


def set_hash(s: np.ndarray) -> int:
    return int(mix64(np.add.reduce(mix64(s + np.uint64(1)), keepdims=True) + np.uint64(len(s)))[0])


def signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _signatures(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Rows (kind 0: doc_id, size, set hash) and, at the end, (kind 1: count, shingle)."""
    pw, often = Powers(), Frequent(SUMMARY)
    for pdf in batches:
        n, h = [], []
        for s in shingles(list(pdf["text"]), size, pw):
            n.append(len(s))
            h.append(set_hash(s))
            often.add(s)
        yield pd.DataFrame({"kind": 0, "id": pdf["doc_id"], "n": n, "h": signed(np.array(h, np.uint64))})
    often.fold()
    at = often.counts > 1
    yield pd.DataFrame({"kind": 1, "id": 0, "n": often.counts[at], "h": signed(often.keys[at])})


def words(s: np.ndarray, frequent: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(band, keys): the words that a set emits in each of its size bands."""
    n = len(s)
    top = 0
    while STEP ** (top + 1) <= n:
        top += 1
    late = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s if len(frequent) else np.zeros(n, bool)
    out = []
    for band in (top, top - 1):
        most = RATIO * STEP**band
        if band < 0 or n >= most:
            continue
        parts = np.uint64(most if most > 1024 else 1 << 40)
        part = mix64(s ^ np.uint64(0x5BD1E995)) % parts + np.where(late, parts, np.uint64(0))
        by = np.argsort(part, kind="stable")
        part = part[by]
        head = np.flatnonzero(np.append(True, part[1:] != part[:-1]))[: emitted(n) + 1]
        ends = head[: emitted(n)]
        word = np.bitwise_xor.reduceat(s[by][: head[-1] if len(head) > emitted(n) else n], ends)
        out.append((band, mix64(mix64(word) + part[ends] * np.uint64(64) + np.uint64(band))))
    return out


def _emit(batches: Iterator[pd.DataFrame], size: int, shared) -> Iterator[pd.DataFrame]:
    """Rows (key, node) of the words of each class, once a task: of a large group of copies
    hardly more rows come than there are tasks."""
    pw, frequent, done = Powers(), shared.value, set()
    for pdf in batches:
        keys, nodes, held = [], [], 0

        def rows() -> pd.DataFrame:
            return pd.DataFrame({"key": signed(np.concatenate(keys)), "node": signed(np.concatenate(nodes))})

        for s in shingles(list(pdf["text"]), size, pw):
            if not len(s):
                continue
            node = set_hash(s)
            if node in done:
                continue
            if len(done) < REMEMBERED:
                done.add(node)
            for _, k in words(s, frequent):
                keys.append(k)
                nodes.append(np.full(len(k), node, np.uint64))
                held += len(k)
            if held > 1 << 19:
                yield rows()
                keys, nodes, held = [], [], 0
        if held:
            yield rows()


def parity(s: np.ndarray) -> np.ndarray:
    """Bits set an odd number of times, packed."""
    at = (mix64(s + np.uint64(77)) % np.uint64(SKETCH)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=SKETCH).astype(np.uint8) & 1)


def _sets(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    pw = Powers()
    for pdf in batches:
        step = 500
        for a in range(0, len(pdf), step):
            rows = pdf.iloc[a : a + step]
            made = list(shingles(list(rows["text"]), size, pw))
            yield pd.DataFrame(
                {
                    "node": rows["node"], "n": [len(x) for x in made],
                    "s": [x.tobytes() for x in made], "b": [parity(x).view(np.int64) for x in made],
                }
            )


def linked(x: bytes, y: bytes) -> bool:
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if DEN * len(small) < NUM * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return DEN * both >= NUM * (len(a) + len(b) - both)


@F.pandas_udf(T.BooleanType())
def _linked(sx: pd.Series, sy: pd.Series) -> pd.Series:
    return pd.Series([linked(*r) for r in zip(sx, sy)], dtype=bool)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (u, v, more columns) whose sets link. The parity sketches, a few bytes a pair,
    rule most pairs out before any set moves: their Hamming distance is a lower bound of the
    symmetric difference. Few links come in one partition: on a local disk Hadoop starts three
    child processes (chmod) of the executor for each stored file."""
    bits = [f"b{i}" for i in range(SKETCH // 64)]
    side = lambda end: sets.select(
        F.col("node").alias(end), F.col("n").alias(f"n_{end}"), *[F.col("b")[i].alias(f"{b}_{end}") for i, b in enumerate(bits)]
    )
    near = pairs.join(side("u"), "u").join(side("v"), "v").filter(~apart_by(bits, "n")).select(*pairs.columns)
    near = materialize(near, "near-pairs")
    x = sets.select(F.col("node").alias("u"), F.col("s").alias("su"))
    y = sets.select(F.col("node").alias("v"), F.col("s").alias("sv"))
    found = near.join(x, "u").join(y, "v").filter(_linked("su", "sv")).select(*pairs.columns)
    return found.repartition(1) if near.count() <= ONE_TASK else found


def apart_by(bits: list[str], size: str):
    """Whether the Hamming distance of two sketches rules a link out; columns end in _u and _v."""
    differ = sum((F.bit_count(F.col(f"{b}_u").bitwiseXOR(F.col(f"{b}_v"))) for b in bits), F.lit(0))
    return differ * (DEN + NUM) > (DEN - NUM) * (F.col(f"{size}_u") + F.col(f"{size}_v"))


def _met(state: DataFrame, bits: list[str]) -> DataFrame:
    """u, v, count (common words), enough (those a link needs) of pairs in different components, of
    rows (key, node, n, root, sketch columns ``bits``); pairs that the sketches rule out are left out."""
    x, y = (state.select("key", *[F.col(c).alias(f"{c}_{end}") for c in ("node", "n", "root", *bits)]) for end in "uv")
    on = (x["key"] == y["key"]) & (F.col("node_u") < F.col("node_v")) & (F.col("root_u") != F.col("root_v")) & fits("n_u", "n_v")
    met = x.join(y, on & ~apart_by(bits, "n") if bits else on)
    enough = F.floor(F.first(F.least("n_u", "n_v")) / SPARE) + 1
    return met.groupBy(F.col("node_u").alias("u"), F.col("node_v").alias("v")).agg(F.count(F.lit(1)).alias("count"), enough.alias("enough"))


def fits(a: str, b: str):
    """Whether sets of sizes a and b may link."""
    return DEN * F.least(a, b) >= NUM * F.greatest(a, b)


def classes(docs: DataFrame, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """(id, n, h) of each document, and the stored frequency summary (n, h)."""
    base = materialize(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .filter("doc_id is not null")
        .mapInPandas(lambda it: _signatures(it, size), "kind int, id long, n long, h long"),
        "signatures",
    )
    return base.filter("kind = 0").select("id", "n", "h"), base.filter("kind = 1").select("n", "h")


def link(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest doc_id with this very set), component_id (smallest
    doc_id reachable by links)."""
    with small_batches(docs.sparkSession):  # every step that runs Python is stored inside
        return _link(docs, size)


def _link(docs: DataFrame, size: int) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    base, summary = classes(docs, size)
    total = base.filter("n > 0").count()
    # At most OFTEN times the mean set size in number, as each is in 1/OFTEN of all documents, and
    # MOST_FREQUENT in any case.
    often = (
        summary.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(20, total // OFTEN))
        .orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).select("h").toPandas()["h"].to_numpy(np.int64)
    )
    shared = spark.sparkContext.broadcast(np.sort(often.view(np.uint64)))
    keys = materialize(docs.mapInPandas(lambda it: _emit(it, size, shared), "key long, node long"), "words")
    # Words that one class alone emits meet nothing. They are found by the least and the greatest
    # class of each word, and a share of the words at a time bounds the disk that this takes.
    parts = []
    for p in range(PASSES):
        mine = keys.filter(F.pmod("key", F.lit(PASSES)) == p)
        same = mine.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high")
        # Stored first: a join between plain exchanges is one whose hot keys are split.
        same = materialize(same.select("key"), "shared-word-keys")
        parts.append(materialize(mine.join(same.hint("shuffle_hash"), "key", "left_semi"), "shared-words"))
        release(spark, same)
    release(spark, keys)
    hits = reduce(DataFrame.unionByName, parts)
    # A class that is to link shares at least 1 + spare(smaller size) words with one other. The
    # share of its words that others hold tells how central a class is.
    sizes = base.filter("n > 0").select(F.col("h").alias("node"), "n").distinct()
    enough = F.floor(F.floor(F.col("n") * NUM / DEN) / SPARE) + 1
    likely = hits.groupBy("node").count().join(sizes, "node").filter(F.col("count") >= enough)
    likely = materialize(likely.select("node", "n", (F.col("count") / F.col("n")).alias("w")), "likely-classes")
    # Stored before copies are dropped: nothing above the join then keeps a hot class in one task.
    joined = materialize(hits.join(likely.hint("shuffle_hash"), "node"), "likely-rows")
    release(spark, hits)
    hits = materialize(joined.distinct(), "likely-words")
    release(spark, joined)
    first = base.filter("n > 0").groupBy("h").agg(F.min("id").alias("doc_id"))
    wanted = first.join(hits.select(F.col("node").alias("h")).distinct(), "h", "left_semi")
    sets = materialize(
        docs.join(wanted.withColumnRenamed("h", "node"), "doc_id")
        .select("node", "text")
        .mapInPandas(lambda it: _sets(it, size), "node long, n long, s binary, b array<long>")
        .dropDuplicates(["node"]),
        "sets",
    )
    roots = _roots(hits, sets)
    named = (
        first.join(roots, first["h"] == roots["node"], "left")
        .select("h", "doc_id", F.coalesce("root", "h").alias("root"))
    )
    low = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.join(low, "root").select("h", F.col("doc_id").alias("class_id"), "component_id")
    empty = base.filter("n = 0").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("id").alias("class_id"), F.col("id").alias("component_id")
    )
    return (
        base.filter("n > 0").join(named, "h")
        .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "class_id", "component_id")
        .unionByName(empty)
    )


def _roots(hits: DataFrame, sets: DataFrame) -> DataFrame:
    """node, root of every class in hits (key, node, n, w).

    Each round takes one leader for every word group that still spans several components: first the
    class with most of its words shared, later a random one. Each class is verified against the
    leader it shares most words with. Rounds end when pairs of different components that share a word
    are few against the rows of hits, or after ROUNDS. All those pairs are counted then; those that
    share 1 + s words and whose parity sketches lie within the bound are verified: no link between
    components is left."""
    spark, rows = hits.sparkSession, hits.count()
    roots = materialize(hits.select("node", F.col("node").alias("root")).distinct(), "roots")
    held, state = hits, hits.withColumn("root", F.col("node"))

    def merged(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        found = components(links.select(F.col("ru").alias("u"), F.col("rv").alias("v")))
        moved = found.select(F.col("node").alias("root"), F.col("root").alias("_to"))
        onto = lambda df: df.join(moved, "root", "left").withColumn("root", F.coalesce("_to", "root")).drop("_to")
        return materialize(onto(roots), "roots"), onto(state)

    for r in range(ROUNDS):
        rank = F.xxhash64("node", F.lit(r)) if r else -F.col("w")
        groups = materialize(
            state.groupBy("key")
            .agg(F.min("root").alias("a"), F.max("root").alias("b"), F.min(F.struct(rank.alias("rank"), "node", "root", "n")).alias("lead"))
            .filter("a <> b")
            .select("key", F.col("lead.node").alias("u"), F.col("lead.root").alias("ru"), F.col("lead.n").alias("nu")),
            "leaders",
        )
        state = materialize(state.select("key", "node", "n", "root", "w").join(groups, "key"), "open-words")
        release(spark, held, groups)
        held = state
        sums = state.groupBy("key", "root").count().groupBy("key").agg(F.sum("count").alias("g"), F.sum(F.col("count") * F.col("count")).alias("q"))
        sums = materialize(sums.agg(F.sum((F.col("g") * F.col("g") - F.col("q")) / 2).alias("pairs")), "pairs-left")
        pairs = sums.first()[0] or 0
        if pairs <= FEW * rows and (r or not pairs):
            break
        votes = state.filter(F.col("root") != F.col("ru")).filter(fits("n", "nu")).groupBy("node", "root", "u", "ru").count()
        best = votes.groupBy(F.col("node").alias("v"), F.col("root").alias("rv")).agg(F.max_by(F.struct("u", "ru"), F.struct("count", "u")).alias("x"))
        roots, state = merged(verified(best.select("v", "rv", "x.u", "x.ru"), sets))
    # Pairs of a small group are a bounded number a row. In a large group the sketches stand beside
    # the words, so that the join itself drops pairs apart and nothing grows with the group's square.
    sized = materialize(state.groupBy("key").count().filter(F.col("count") > SMALL).select("key"), "large-groups")
    rows_of = state.select("key", "node", "n", "root")
    sketches = sets.select("node", *[F.col("b")[i].alias(f"b{i}") for i in range(SKETCH // 64)])
    few = _met(rows_of.join(sized, "key", "left_anti"), [])
    many = _met(rows_of.join(sized, "key", "left_semi").join(sketches, "node"), sketches.columns[1:])
    apart = materialize(
        few.unionByName(many).groupBy("u", "v").agg(F.sum("count").alias("count"), F.first("enough").alias("enough"))
        .filter("count >= enough").select("u", "v"),
        "pairs-apart",
    )
    named = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"r{end}"))
    roots = merged(verified(apart.join(named("u"), "u").join(named("v"), "v"), sets))[0]
    release(spark, held)
    return roots


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` with one document (the smallest doc_id) of each component. Copies of a row, with one
    doc_id and text, stay once; rows without doc_id take no part and all stay."""
    keep = link(docs).filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_keep")).distinct()
    known = docs.filter("doc_id is not null")
    out = known.join(keep, known["doc_id"] == keep["_keep"], "left_semi")
    again = known.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_again"))
    again = materialize(again, "repeated-ids")
    if not again.isEmpty():  # else no text is compared
        same = out["doc_id"] == again["_again"]
        copies = out.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])
        out = out.join(again, same, "left_anti").unionByName(copies)
    return out.unionByName(docs.filter("doc_id is null"))


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet"))


JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM {docs}),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[j : j + 4], ' ') AS g FROM (
    SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS j FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS whole FROM s GROUP BY doc_id),
cls AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY whole) AS class_id FROM n),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 75 * (a.n + b.n - i)),
either_way AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS c FROM {docs} UNION SELECT either_way.y, r.c FROM r JOIN either_way ON either_way.x = r.doc_id),
c AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(class_id, doc_id) AS class_id, component_id
FROM c LEFT JOIN cls USING (doc_id)
"""
