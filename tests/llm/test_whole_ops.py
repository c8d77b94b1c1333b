"""Operators that leave nothing out, against plain versions on small tables."""

import math
import random
import string
import time
from collections import Counter

import numpy as np
import pytest

from framewright.llm import decontaminate, jaccard, mixing, secrets, topk
from framewright.llm.common import shared_dir


def test_many_patterns_are_routed_like_few():
    rng = random.Random(5)
    for _ in range(150):
        names = [None, *"abcdef"][: rng.randint(1, 7)]
        patterns = {tuple(sorted(rng.sample(names, rng.randint(0, len(names))), key=repr)): rng.randint(0, 30) for _ in range(12)}
        quotas = {s: rng.randint(0, 60) for s in names}
        few, many = (mixing.route(patterns, quotas, 3, most) for most in (100, 0))
        assert few.keys() == many.keys() and all(0 <= many[m] <= 3 * patterns[m] for m in many)
        for k in (1, 2, 3):
            first = lambda given: sum(min(x, k * patterns[m]) for m, x in given.items())
            assert first(few) == first(many)


def test_mix_keeps_memberships_of_many_patterns(spark):
    kinds = [["a"], ["b"], ["a", "b"], ["b", "c"], ["a", "c"]]
    df = spark.createDataFrame([(i, "x " * 10, kinds[i % 5]) for i in range(50)], "doc_id long, text string, members array<string>")
    few, many = (mixing.mix(df, "members", max_patterns=n, max_sources=n).collect() for n in (100, 1))
    shape = lambda rows: sorted((r["doc_id"], r["size"], r["source_size"], r["target"]) for r in rows)
    assert shape(few) == shape(many) and sum(r["taken"] for r in few) == sum(r["taken"] for r in many)


def test_more_patterns_than_the_default(spark):
    sets = [[f"s{k:02d}" for k in range(14) if i >> k & 1] for i in range(1, 1 << 14)]
    df = spark.createDataFrame([(i, "x y z", m) for i, m in enumerate(sets)], "doc_id long, text string, members array<string>")
    rows = mixing.mix(df, "members", weights=(1,), share=0.1).collect()
    assert len(rows) == len(sets) and {r["source_size"] for r in rows} == {3 << 13}
    # A quota is a tenth of 24,576 words, and unused words fill all fourteen.
    assert sum(r["taken"] for r in rows) == 14 * 2458 and max(r["taken"] for r in rows) == 3


def test_jaccard_clean_keeps_rows_without_id_and_one_of_each_copy(spark):
    text = "same text twice with enough words here"
    rows = [(None, "no id"), (None, None), (5, text), (5, text), (6, text), (7, None), (7, None), (8, "other words"), (9, "a"), (9, "b")]
    docs = spark.createDataFrame([(t, i) for i, t in rows], "text string, doc_id long")
    out = jaccard.clean(docs)
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
    want = [(None, "no id"), (None, None), (5, text), (7, None), (8, "other words"), (9, "a"), (9, "b")]
    assert out.columns == docs.columns and got == sorted(want, key=repr)
    once = docs.filter("doc_id is null or doc_id in (6, 8)")
    assert jaccard.clean(once).count() == 4


def test_sources_of_one_pattern_are_in_the_network(spark):
    patterns, quotas = {("a",): 10, ("b",): 7, (None,): 3}, {"a": 20, "b": 4, None: 5}
    flow, gives = mixing.network(patterns, quotas, 2)
    flow.run("start", "end")
    carried = {m: sum(words - flow.edges[i][1] for i, words in each) for m, each in gives.items()}
    assert len(flow.edges) == 2 * (3 * 2 + 3 + 3) and carried == {("a",): 20, ("b",): 4, (None,): 5}
    assert mixing.route(patterns, quotas, 2) == mixing.route(patterns, quotas, 2, 0) == carried


def test_twenty_thousand_overlapping_patterns():
    rng = random.Random(6)
    names = [f"s{k:03d}" for k in range(200)]
    patterns = {(n,): 50 for n in names}
    while len(patterns) < 20_000:
        patterns[tuple(sorted(rng.sample(names, rng.randint(2, 6))))] = rng.randint(1, 30)
    words = Counter()
    for m, n in patterns.items():
        words.update(dict.fromkeys(m, n))
    quotas = {s: rng.randint(0, 2 * words[s] // 5) for s in names}
    began = time.time()
    given = mixing.route(patterns, quotas, 2)
    assert time.time() - began < 30
    assert all(0 <= given[m] <= 2 * n for m, n in patterns.items())
    # Sources are so mixed that all quotas can be met, or all words are used twice.
    assert sum(given.values()) == min(sum(quotas.values()), 2 * sum(patterns.values()))


def plain_entropy(run, window):
    best = None
    for i in range(len(run) - window + 1):
        e = -sum(n / window * math.log2(n / window) for n in Counter(run[i : i + window]).values())
        best = e if best is None else max(best, e)
    return best


def test_entropy_windows_by_plain_loops(spark):
    from pyspark.sql import functions as F

    rng = random.Random(8)
    alphabet = string.ascii_letters + string.digits + "+/_-"
    runs = ["".join(rng.choice(alphabet[: rng.randint(1, 66)]) for _ in range(n)) for n in (1, 19, 20, 21, 22, 40, 63, 200)]
    df = spark.createDataFrame([(r,) for r in runs], "run string")
    for window in (20, 5, 31, 40):
        got = {r["run"]: r["e"] for r in df.select("run", secrets.window_entropy(F.col("run"), window, alphabet).alias("e")).collect()}
        for run in runs:
            want = plain_entropy(run, window)
            assert got[run] == (None if want is None else pytest.approx(want, abs=1e-9))


def test_a_run_of_a_megabyte_and_very_many_matches(spark):
    rng = random.Random(4)
    alphabet = string.ascii_letters + string.digits + "+/"
    run = "".join(rng.choices(alphabet, k=1_000_000))
    spans = " ".join("%016x" % rng.getrandbits(64) for _ in range(20_000))
    df = spark.createDataFrame([(1, "key " + run), (2, spans), (3, None)], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["secret_spans"]] for r in secrets.scan(df).collect()}
    assert time.time() - began < 60
    assert ("entropy_b64", 4, 1_000_004) in got[1] and got[3] == []
    assert [s for s in got[2] if s[0] == "hex"] == [("hex", 17 * i, 17 * i + 16) for i in range(20_000)]


@pytest.mark.parametrize("scale", [1.0, 3e4, 3e5])
def test_topk_is_exact_at_any_size_and_length(spark, scale):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(int(scale) % 97)
    rows = [(i, (rng.normal(size=6 if i % 4 else 3) * scale).tolist()) for i in range(90)]
    if scale > 1:  # scores that only differ in their last bits
        rows += [(100 + i, [scale * 64, scale * 64 + i / 64, 0.0, 0.0, 0.0, 0.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = {i: [math.floor(64 * x) for x in v] for i, v in rows}
    got = Counter(tuple(r) for r in topk.search(df, F.col("vec_id") % 10 == 0, block=4).collect())
    want = Counter()
    for i in (i for i in q if i % 10 == 0):
        score = {j: sum(x * y for x, y in zip(q[i], q[j])) for j in q if j != i and len(q[j]) == len(q[i])}
        best = sorted(score, key=lambda j: (-score[j], j))[:20]
        want.update((i, rank + 1, j, score[j]) for rank, j in enumerate(best))
    assert got == want


@pytest.mark.parametrize("block_words", [2_000_000, 12])
def test_longest_matches_by_brute_force(spark, block_words):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 10, 14, 25])))) for i in range(8)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(12)]
    texts += [f"a {items[k][1]} b {items[(k + 1) % 8][1]} c" for k in range(8)] + [items[2][1] + " " + items[2][1], None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for d, text in enumerate(texts):
        mine, best = (text or "").split(), None
        for item, other in items:
            theirs = other.split()
            least = min(10, len(theirs))
            for i in range(len(mine)):
                for j in range(len(theirs)):
                    n = 0
                    while i + n < len(mine) and j + n < len(theirs) and mine[i + n] == theirs[j + n]:
                        n += 1
                    if n >= least and (best is None or (n, -i, -item) > (best[0], -best[1], -best[2])):
                        best = (n, i, item)
        want[d] = list(best or ())
    found = decontaminate.flag(docs, bench, block_words=block_words)
    assert {r["doc_id"]: list(r["decon_longest"]) for r in found.collect()} == want and sum(map(bool, want.values())) > 8


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                class sc:
                    class getCheckpointDir:
                        isDefined = staticmethod(lambda: False)

    with pytest.raises(ValueError):
        shared_dir(Session)
