"""Operator 5, removal of repeated byte strings by blockwise suffix sorting.

Every byte covered by a ``length``-byte string that also starts somewhere else (in any document,
the same one included) is removed. Strings are judged on the input.

Suffix buckets. A window is a string of ``length`` bytes; the suffix that begins with it matters
only that far. Each window has an anchor: of the k-grams inside it (k a quarter of the length),
the one with the smallest hash, the leftmost if equal. Equal windows have equal anchors at equal
offsets, so a bucket is the set of windows with one anchor hash, and no pair of equal windows lies
in two buckets. Neighbouring windows mostly share an anchor, so a bucket holds segments: the text
span of a run of windows. Two counts settle most of the text without any sorting: a bucket of one
segment has no repeats; segments that are equal as a whole (a hash of the span and its place at
the anchor) repeat in full. Only buckets with several different segments are sorted, and of equal
segments one stands for all, so a group of copies, however large, adds one segment.

Difference cover. Sorting takes one block of buckets at a time (half a MB or one bucket), so memory
is bounded by the block. Suffixes are put in the order of their first ``length`` bytes: first by v
bytes (v the largest divisor of the length up to 16), by a sort of the bytes themselves. Ties, which
are long in near copies, are not compared byte by byte: for any two phases modulo v there is a step
under v that brings both to positions of the difference cover, whose ranks by the length - v bytes
that follow were computed before, by doubling from v bytes; where those agree too, the last v bytes
decide. Tied groups are split by a pivot each, all groups at once, into less, equal and greater,
until each holds equal windows only. Ranks are those of the bytes, so nothing inside a block rests
on hashes.

A bucket with more than ``most`` different segments is not gathered in a task: it is thinned once
more by equal stretches of segments, and the windows that are left become rows keyed by prefix,
what lies between and tail (as fingerprints), counted by a distributed aggregation, which splits
any group.

Segments and stretches that count as equal as a whole, and windows of large buckets, are equal by
64-bit fingerprints of their bytes and place.

A text longer than a slice is cut into segments slice by slice, each slice with the bytes that its
last window needs; segments end there, which changes no window.

``passages`` runs the same search over words in place of bytes.

Null texts count as empty. Texts shorter than ``length`` hold no window. Repeated rows repeat each
other's text in full and are removed both. Rows without doc_id keep their text and
repeat nothing; doc_id names one text, so rows that share a doc_id must share their text. An empty table
gives an empty result. Extra columns pass through ``remove_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import materialize, release, small_batches
from framewright.llm.textkit import Powers, chunks, join_utf8, long_word_hashes, mix64, prefix_hash, word_hashes

LENGTH, MOST, BLOCK, STRETCH, SLICE, WORDS, CODE = 400, 64, 1 << 19, 16, 1 << 20, 51, 3
_POWERS = Powers()


def fingerprints(c: np.ndarray, starts: np.ndarray, n, pw: Powers) -> np.ndarray:
    """Hashes of the ``n`` bytes at each start; c is the buffer's prefix hash."""
    _, down = pw.of(len(c))
    return mix64((c[starts + n] - c[starts]) * down[starts])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive values, by prefix and suffix minima of blocks of w."""
    n = len(x)
    pad = -n % w
    y = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(y, 1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def as_bytes(texts: list) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def as_words(texts: list) -> list[bytes]:
    """CODE bytes for each word of a text, from its hash: strings of words as strings of bytes."""
    pw, out = _POWERS, []
    for lo, hi in chunks(texts):
        if hi - lo == 1 and len(texts[lo] or "") > SLICE:
            words = long_word_hashes(texts[lo], pw)
            first = np.array([0, len(words)])
        else:
            words, first = word_hashes(*join_utf8(texts[lo:hi]), pw)
        codes = words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :CODE]
        out += [codes[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
    return out


def slices(raws: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(buffer, text offsets, number of the first text, byte of it that the buffer starts at) of
    ranges of texts, and of slices of a text that is too long to stand in one."""
    for lo, hi in chunks(raws):
        if hi - lo == 1 and len(raws[lo]) > SLICE:
            for a in range(0, len(raws[lo]) - length + 1, SLICE):
                part = np.frombuffer(raws[lo][a : a + SLICE + length - 1] + b" ", np.uint8)
                yield part, np.array([0, len(part)]), lo, a
        else:
            offsets = np.cumsum([0, *(len(r) + 1 for r in raws[lo:hi])])
            yield np.frombuffer(b" ".join(raws[lo:hi]) + b" ", np.uint8), offsets, lo, 0


def segments(raws: list[bytes], length: int, pw: Powers) -> Iterator[tuple]:
    """For ranges of texts: (text number, anchor hash, first window, windows, offset of the anchor
    from the first window, hash of the whole span) of every segment."""
    k = max(1, length // 4)
    w = length - k + 1
    for buf, offsets, lo, skipped in slices(raws, length):
        if len(buf) < length:
            continue
        c = prefix_hash(buf, pw)
        grams = fingerprints(c, np.arange(len(buf) - k + 1), k, pw)
        # Position in the low half: the smallest is the leftmost among equal upper halves.
        keys = ((grams >> np.uint64(32)) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
        anchor = (sliding_min(keys, w) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        at = np.arange(len(anchor))
        owner = np.searchsorted(offsets, at, "right") - 1
        ok = at + length <= offsets[owner + 1] - 1
        at, owner, anchor = at[ok], owner[ok], anchor[ok]
        if not len(at):
            continue
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(anchor) != 0) | (np.diff(at) != 1) | (np.diff(owner) != 0)
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(at)))
        first, a = at[head], anchor[head]
        whole = fingerprints(c, first, size - 1 + length, pw)
        place = (a - first).astype(np.uint64) * np.uint64(1 << 20) + size.astype(np.uint64)
        yield owner[head] + lo, grams[a], first - offsets[owner[head]] + skipped, size, a - first, mix64(whole ^ mix64(place))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def _segments(batches: Iterator[pd.DataFrame], length: int, unit) -> Iterator[pd.DataFrame]:
    pw = Powers()
    for pdf in batches:
        ids = pdf["doc_id"].to_numpy()
        for owner, anchor, first, size, offset, whole in segments(unit(list(pdf["text"])), length, pw):
            yield pd.DataFrame(
                {
                    "anchor": signed(anchor), "whole": signed(whole), "doc_id": ids[owner],
                    "first": first, "size": size.astype(np.int32), "offset": offset.astype(np.int32),
                }
            )


def cover(v: int) -> np.ndarray:
    """Residues modulo v such that every difference modulo v is one of two of them: a run of r
    and every r-th residue, r the square root of v rounded up."""
    r = int(np.ceil(np.sqrt(v)))
    return np.unique(np.concatenate([np.arange(r), np.arange(r, v + r, r)]) % v)


def steps(v: int) -> np.ndarray:
    """For two phases modulo v, the least step that brings both into the cover."""
    inside = np.zeros(v, bool)
    inside[cover(v)] = True
    at = (np.arange(v)[:, None] + np.arange(v)) % v  # phase, step
    return (inside[at][:, None, :] & inside[at][None, :, :]).argmax(2)


def period(length: int) -> int:
    """The largest divisor of ``length`` up to its fifth part and 16 (1 if there is none)."""
    return max(d for d in range(1, min(16, max(1, length // 5)) + 1) if length % d == 0)


def dense(key: np.ndarray) -> np.ndarray:
    """Ranks from 0; equal ranks for equal keys."""
    by = np.argsort(key)
    new = np.zeros(len(by), bool)
    new[1:] = key[by[1:]] != key[by[:-1]]
    out = np.empty(len(by), np.int64)
    out[by] = np.cumsum(new)
    return out


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ranks by two ranks (-1 at least), the first one leading. Both are at most the buffer's length,
    so the pair is one number."""
    return dense((a + 1) * (int(b.max(initial=0)) + 2) + b + 1)


def byte_ranks(buf: np.ndarray, v: int) -> np.ndarray:
    """Rank of every position by the v bytes that begin there (v up to 16)."""
    n = len(buf) - v + 1
    ranks = []
    for a in range(0, v, 8):
        key = np.zeros(n, np.uint64)
        for j in range(a, min(v, a + 8)):
            key = (key << np.uint64(8)) | buf[j : j + n]
        ranks.append(dense(key))
    return reduce(paired, ranks)


def cover_ranks(first: np.ndarray, v: int, blocks: int) -> np.ndarray:
    """Rank of every position of the difference cover by the ``blocks`` * v bytes that begin there
    (-1 elsewhere), doubled from ``first``, the ranks by v bytes. What lies behind the end is least."""
    where = np.flatnonzero(np.isin(np.arange(len(first)) % v, cover(v)))
    level, total = np.full(len(first), -1, np.int64), np.full(len(first), -1, np.int64)
    level[where] = first[where]
    # Positions of one phase lie v apart, so the next ones are of the cover too.
    shifted = lambda x, n: np.where(where + n * v < len(x), x[np.minimum(where + n * v, len(x) - 1)], -1)
    have, done = 1, 0
    while True:
        if blocks & have:
            total[where] = paired(total[where], shifted(level, done)) if done else level[where]
            done += have
        if done == blocks:
            return total
        level[where] = paired(level[where], shifted(level, have))
        have *= 2


def window_order(buf: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the windows by their ``length`` bytes, whether each in that order differs from the
    one before). All windows lie inside buf, which goes on for v bytes at least."""
    v = period(length)
    first = byte_ranks(buf, v)
    sample, step = cover_ranks(first, v, length // v - 1), steps(v)
    head, tail, phase = first[starts], first[starts + length - v], starts % v
    order = np.argsort(head)
    new = np.append(True, head[order][1:] != head[order][:-1])
    open_at = np.arange(len(order))  # places in the order whose group is not settled
    while True:
        group = np.cumsum(new[open_at]) - 1
        size = np.bincount(group)
        open_at, group = open_at[size[group] > 1], group[size[group] > 1]
        if not len(open_at):
            return order, new
        begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        count = np.diff(np.append(begin, len(group)))
        at = order[open_at]
        pivot = np.repeat(at[begin + count // 2], count)
        d = step[phase[at], phase[pivot]]
        a, b = sample[starts[at] + d], sample[starts[pivot] + d]
        side = np.where(a != b, np.sign(a - b), np.sign(tail[at] - tail[pivot]))
        by = np.argsort(np.repeat(np.arange(len(count)), count) * 3 + side + 1)
        order[open_at], side = at[by], side[by]
        new[open_at[1:]] |= side[1:] != side[:-1]
        open_at = open_at[side != 0]


def _cut(batches: Iterator[pd.DataFrame], length: int, unit) -> Iterator[pd.DataFrame]:
    """The bytes of the wanted segments of each text."""
    for pdf in batches:
        out: dict = {c: [] for c in ("anchor", "big", "doc_id", "first", "size", "offset", "span")}
        held = 0
        for doc, text, want in zip(pdf["doc_id"], pdf["text"], pdf["want"]):
            (raw,) = unit([text])
            for w in want:
                out["anchor"].append(w["anchor"])
                out["big"].append(w["big"])
                out["doc_id"].append(doc)
                out["first"].append(w["first"])
                out["size"].append(w["size"])
                out["offset"].append(w["offset"])
                out["span"].append(raw[w["first"] : w["first"] + w["size"] - 1 + length])
                held += w["size"] + length
            if held > 1 << 22:
                yield pd.DataFrame(out)
                out, held = {c: [] for c in out}, 0
        if held:
            yield pd.DataFrame(out)


def repeats_of(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """doc_id, first, size of the runs of windows in these segments that occur twice among them."""
    base = np.cumsum([0, *map(len, rows["span"])])[:-1]
    # Room behind the last window for cover positions a little further on.
    buf = np.frombuffer(b"".join(rows["span"]) + b"\0" * (2 * period(length)), np.uint8)
    size = rows["size"].to_numpy(np.int64)
    row = np.repeat(np.arange(len(rows)), size)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    order, new = window_order(buf, base[row] + inner, length)
    # A window occurs again if it equals the one before or after it in the order.
    same = np.append(~new[1:], False) | ~new
    twice = np.zeros(len(order), bool)
    twice[order] = same
    return runs(rows, row[twice], inner[twice])


def runs(rows: pd.DataFrame, row: np.ndarray, inner: np.ndarray) -> pd.DataFrame:
    new = np.ones(len(row), bool)
    new[1:] = (np.diff(row) != 0) | (np.diff(inner) != 1)
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(row)))
    return pd.DataFrame(
        {"doc_id": rows["doc_id"].to_numpy()[row[head]], "first": rows["first"].to_numpy()[row[head]] + inner[head], "size": size}
    )


def _sort_blocks(batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """Batches come sorted by anchor; a block is cut where the anchor changes."""
    held = None
    for pdf in batches:
        held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        while len(held):
            ends = held["span"].map(len).to_numpy().cumsum()
            anchor = held["anchor"].to_numpy()
            change = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
            full = change[ends[change - 1] >= BLOCK]
            if not len(full):
                break
            yield repeats_of(held.iloc[: full[0]], length)
            held = held.iloc[full[0] :].reset_index(drop=True)
    if held is not None and len(held):
        yield repeats_of(held, length)


def _places(rows: pd.DataFrame, pw: Powers) -> tuple:
    """(prefix hash of the joined spans, row, window in its segment, byte) of every window."""
    buf = np.frombuffer(b"".join(rows["span"]) + b"\0", np.uint8)
    size = rows["size"].to_numpy(np.int64)
    base = np.cumsum([0, *rows["span"].map(len)])[:-1]
    row = np.repeat(np.arange(len(rows)), size)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    return prefix_hash(buf, pw), row, inner, base[row] + inner


def _stretches(batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """Segments in stretches of STRETCH windows, counted from the anchor, each with the hash of
    its span and place."""
    pw = Powers()
    for pdf in batches:
        for a in range(0, len(pdf), 256):
            rows = pdf.iloc[a : a + 256]
            c, row, inner, at = _places(rows, pw)
            to_anchor = inner - rows["offset"].to_numpy(np.int64)[row]
            stretch = to_anchor // STRETCH
            head = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(stretch) != 0)))
            size = np.diff(np.append(head, len(row)))
            whole = fingerprints(c, at[head], size - 1 + length, pw)
            place = mix64((to_anchor[head] + (1 << 30)).astype(np.uint64) * np.uint64(1 << 20) + size.astype(np.uint64))
            yield pd.DataFrame(
                {
                    "anchor": rows["anchor"].to_numpy()[row[head]], "stretch": stretch[head], "whole": signed(mix64(whole ^ place)),
                    "doc_id": rows["doc_id"].to_numpy()[row[head]], "segment": rows["first"].to_numpy()[row[head]], "inner": inner[head], "size": size,
                }
            )


def _windows(batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """Rows of single windows of the wanted stretches, with the three parts of their key in two
    fingerprints."""
    pw, v = Powers(), period(length)
    for pdf in batches:
        for a in range(0, len(pdf), 256):
            rows = pdf.iloc[a : a + 256]
            c, row, inner, at = _places(rows, pw)
            stretch = (inner - rows["offset"].to_numpy(np.int64)[row]) // STRETCH
            use = np.concatenate([np.isin(stretch[row == i], w) for i, w in enumerate(rows["want"])])
            row, inner, at = row[use], inner[use], at[use]
            yield pd.DataFrame(
                {
                    "head": signed(mix64(fingerprints(c, at, v, pw)) + fingerprints(c, at + length - v, v, pw)),
                    "body": signed(fingerprints(c, at + v, length - v, pw)),
                    "doc_id": rows["doc_id"].to_numpy()[row],
                    "first": rows["first"].to_numpy()[row] + inner,
                }
            )


def _large_buckets(spans: DataFrame, length: int, ident: str) -> DataFrame:
    """The repeats among segments of buckets too large for one task. As with segments, equal
    stretches repeat in full and one stands for all; only the windows of different stretches at
    one place of a bucket become rows, and an aggregation finds those that occur twice."""
    stretches = materialize(
        spans.mapInPandas(
            lambda it: _stretches(it, length),
            f"anchor long, stretch long, whole long, doc_id {ident}, segment long, inner long, size long",
        ),
        "stretches",
    )
    keys = ["anchor", "stretch", "whole"]
    distinct = materialize(
        stretches.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "segment")).alias("at")), "distinct-stretches"
    )
    in_full = stretches.join(distinct.filter("n > 1").select(*keys), keys, "left_semi").select(
        "doc_id", (F.col("segment") + F.col("inner")).alias("first"), "size"
    )
    open_places = materialize(
        distinct.groupBy("anchor", "stretch")
        .agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"))
        .filter("kinds > 1 and least = 1")
        .select("anchor", "stretch"),
        "open-stretches",
    )
    wanted = (
        distinct.join(open_places, ["anchor", "stretch"])
        .groupBy("anchor", F.col("at.doc_id").alias("doc_id"), F.col("at.segment").alias("first"))
        .agg(F.collect_list("stretch").alias("want"))
    )
    windows = materialize(
        spans.join(wanted, ["anchor", "doc_id", "first"])
        .select("anchor", "doc_id", "first", "size", "offset", "span", "want")
        .mapInPandas(lambda it: _windows(it, length), f"head long, body long, doc_id {ident}, first long"),
        "windows",
    )
    twice = materialize(windows.groupBy("head", "body").count().filter("count > 1").select("head", "body"), "twice")
    single = windows.join(twice, ["head", "body"], "left_semi").select("doc_id", "first", F.lit(1).cast("long").alias("size"))
    return materialize(in_full, "stretches-in-full").unionByName(materialize(single, "single-windows"))


def repeat_runs(docs: DataFrame, length: int = LENGTH, most: int = MOST, unit=as_bytes) -> DataFrame:
    """doc_id, first, size: runs of windows (byte offset of the first, number) that occur elsewhere,
    in texts as the bytes that ``unit`` makes of them. Stored."""
    with small_batches(docs.sparkSession):  # every step that runs Python is stored inside
        return _repeat_runs(docs, length, most, unit)


def _repeat_runs(docs: DataFrame, length: int, most: int, unit) -> DataFrame:
    ident = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    found = materialize(
        docs.filter(F.octet_length("text") >= length - 1).mapInPandas(
            lambda it: _segments(it, length, unit),
            f"anchor long, whole long, doc_id {ident}, first long, size int, offset int",
        ),
        "segments",
    )
    # Buckets of two segments or more; hot ones cost a row for each task before the shuffle.
    # Counts are stored first: a join between plain exchanges is one whose hot keys are split.
    shared = materialize(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"), "shared-anchors")
    every, found = found, materialize(found.join(shared, "anchor", "left_semi"), "shared-segments")
    release(docs.sparkSession, every, shared)
    # One row for each different segment: how often it occurs and one place of it.
    distinct = materialize(
        found.groupBy("anchor", "whole").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "first", "size", "offset")).alias("at")
        ),
        "distinct-segments",
    )
    in_full = found.join(distinct.filter("n > 1").select("anchor", "whole"), ["anchor", "whole"], "left_semi").select(
        "doc_id", "first", F.col("size").cast("long").alias("size")
    )
    # Buckets that hold a segment that occurs once beside others are to be sorted.
    open_buckets = materialize(
        distinct.groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"))
        .filter("kinds > 1 and least = 1")
        .select("anchor", (F.col("kinds") > most).alias("big")),
        "open-buckets",
    )
    wanted = (
        distinct.join(open_buckets, "anchor")
        .groupBy(F.col("at.doc_id").alias("doc_id"))
        .agg(F.collect_list(F.struct("anchor", "at.first", "at.size", "at.offset", "big")).alias("want"))
    )
    spans = materialize(
        docs.join(wanted, "doc_id").select("doc_id", "text", "want").mapInPandas(
            lambda it: _cut(it, length, unit),
            f"anchor long, big boolean, doc_id {ident}, first long, size int, offset int, span binary",
        ),
        "spans",
    )
    sorted_blocks = (
        spans.filter("not big").drop("big").repartition("anchor").sortWithinPartitions("anchor")
        .mapInPandas(lambda it: _sort_blocks(it, length), f"doc_id {ident}, first long, size long")
    )
    large = _large_buckets(spans.filter("big").drop("big"), length, ident)
    # Each part is stored by itself, so that a hot key of its join is split.
    parts = [materialize(in_full, "repeats-in-full"), materialize(sorted_blocks, "repeats-sorted"), large]
    release(docs.sparkSession, found, distinct, open_buckets, spans)
    return reduce(DataFrame.unionByName, parts)


def passages(docs: DataFrame, words: int = WORDS, most: int = MOST) -> DataFrame:
    """doc_id, n_words: how many words of a document lie in passages of ``words`` words or more that
    occur elsewhere, wherever lines break and in either case. The same search as for bytes, over
    CODE bytes of each word's hash; documents without such words are left out."""
    found = repeat_runs(docs, CODE * words, most, as_words)
    # Windows that count begin with a word.
    head, tail = F.ceil(F.col("first") / CODE), F.floor((F.col("first") + F.col("size") - 1) / CODE)
    word = found.filter(head <= tail).select("doc_id", head.alias("a"), (tail + words).alias("b"))
    spans = F.array_sort(F.collect_list(F.struct("a", "b")))
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    total = F.aggregate(
        spans, start,
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["b"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(acc["end"], s["a"]))).alias("n")
        ),
    )
    return word.groupBy("doc_id").agg(total["n"].alias("n_words"))


def _apply(batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        n_bytes, n_removed, n_spans, digest, texts = [], [], [], [], []
        for text, found in zip(pdf["text"], pdf["_fw_runs"]):
            raw = (text or "").encode("utf-8", "surrogatepass")
            kept, end, removed, spans = [], 0, 0, 0
            last = None
            for a, b in sorted((r["first"], r["first"] + r["size"] - 1 + length) for r in found) if found is not None else ():
                if last is not None and a <= last[1]:
                    last[1] = max(last[1], b)
                    continue
                if last is not None:
                    kept.append(raw[end : last[0]])
                    removed, spans, end = removed + last[1] - last[0], spans + 1, last[1]
                last = [a, b]
            if last is not None:
                kept.append(raw[end : last[0]])
                removed, spans, end = removed + last[1] - last[0], spans + 1, last[1]
            kept.append(raw[end:])
            left = b"".join(kept)
            n_bytes.append(len(raw))
            n_removed.append(removed)
            n_spans.append(spans)
            digest.append(hashlib.sha256(left).hexdigest())
            # A cut may fall inside a character; its remains can't be part of a text.
            texts.append(text if not removed else left.decode("utf-8", "ignore"))
        out = pdf.drop(columns="_fw_runs")
        out["text"] = texts
        out["n_bytes"], out["n_removed"], out["n_spans"], out["kept_sha256"] = n_bytes, n_removed, n_spans, digest
        yield out


def remove_repeats(docs: DataFrame, length: int = LENGTH, most: int = MOST) -> DataFrame:
    """``docs`` with repeated strings removed from text, and n_bytes, n_removed, n_spans (maximal
    removed runs), kept_sha256 (of the remaining bytes)."""
    found = repeat_runs(docs, length, most)
    per_doc = found.groupBy(F.col("doc_id").alias("_fw_id")).agg(F.collect_list(F.struct("first", "size")).alias("_fw_runs"))
    joined = docs.join(per_doc, docs["doc_id"] == per_doc["_fw_id"], "left").drop("_fw_id")
    long0 = F.lit(0).cast("long")
    schema = docs.withColumns({"n_bytes": long0, "n_removed": long0, "n_spans": long0, "kept_sha256": F.lit("")}).schema
    return joined.mapInPandas(lambda it: _apply(it, length), schema)


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, and n_passage_words: words of the document in passages of more than
    50 words that occur elsewhere, which may be shorter than 400 bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    shared = passages(docs).withColumnRenamed("n_words", "n_passage_words")
    return remove_repeats(docs).drop("text").join(shared, "doc_id", "left").na.fill(0, ["n_passage_words"])
