"""Learned operators by held-out accuracy, the rollup by recount, the pipeline end to end."""

import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.llm import langid, tokencounts, toxicity
from framewright.llm.common import crc_mod

DATA = "/root/testdata/sf0.01"
here = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_crc_rule(spark):
    for r in spark.range(50).select("id", crc_mod("id", 3).alias("m")).collect():
        assert r["m"] == zlib.crc32(str(r["id"]).encode()) % 3


# ---------------------------------------------------------------- language

@here
def test_language_on_held_out_rows(spark):
    got = langid.op6_language_id(spark, DATA).toPandas().set_index("doc_id")
    want = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id")["lang"]
    assert len(got) == len(want) and got["score"].between(0, 1).all()
    held = got[got["held_out"]]
    assert (held["lang_pred"] == want[held.index]).mean() > 0.98


def made(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))


LETTERS = {"en": "theandwr", "de": "schunßig", "fr": "éàqlveux", "es": "ñóarlcid"}


def languages(spark, extra=()):
    rng = random.Random(1)
    rows = [(i, made(rng, LETTERS[lang], rng.randint(3, 40)), lang, "x") for i, lang in enumerate(list(LETTERS) * 40)]
    return spark.createDataFrame([*rows, *extra], "doc_id long, text string, lang string, lang_pred_x string")


def test_language_odd_rows(spark):
    odd = [(900, None, "en", "x"), (901, "", "en", "x"), (902, "123 ... 456", "de", "x"), (903, "é" * 60_000, "fr", "x"), (904, "the and", None, None)]
    docs = languages(spark, odd)
    model = langid.fit(docs, langid.learn_rule())
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[900]["lang_score"] == 0
    assert got[903]["lang_pred"] == "fr" and got[904]["lang_pred"] == "en"
    assert sum(r["lang_pred"] == r["lang"] for r in got.values() if r["doc_id"] < 900) > 155
    kept = {r["doc_id"] for r in langid.reject(docs).collect()}
    assert not kept & {900, 901, 902} and len(kept) > 150
    assert langid.identify(docs.limit(0), model).count() == 0
    none = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")), langid.learn_rule())
    assert {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}


def test_language_never_sees_lang_source_or_id(spark):
    docs = languages(spark)
    model = langid.fit(docs, langid.learn_rule())
    a = {r["text"]: r["lang_pred"] for r in langid.identify(docs, model).collect()}
    b = {r["text"]: r["lang_pred"] for r in langid.identify(docs.withColumns({"lang": F.lit("zz"), "doc_id": F.col("doc_id") + 7}), model).collect()}
    assert a == b


# ---------------------------------------------------------------- toxicity

@here
def test_toxicity_on_held_out_rows(spark):
    got = toxicity.op10_toxicity(spark, "/root/testdata/sf0.1" if os.path.isdir("/root/testdata/sf0.1") else DATA).toPandas()
    sf = "/root/testdata/sf0.1" if os.path.isdir("/root/testdata/sf0.1") else DATA
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    both = got[got["held_out"]].merge(labels, on="doc_id")
    rank = both["score"].rank()
    n1 = both["toxic"].sum()
    auc = (rank[both["toxic"] == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(both) - n1))
    assert auc > 0.93 and got["score"].between(0, 1).all() and ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()


def test_machine_learns_a_pair_that_no_line_can():
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(1500):
        a, b = rng.random(2) < 0.5
        rows.append(np.array(sorted({*(rng.integers(100, 160, 4)), *([1] if a else []), *([2] if b else [])}), np.int64))
        y.append(int(a != b))
    y = np.array(y)
    m = toxicity.Machine(y.mean())
    m.buckets = np.arange(200)
    m.learn([m.pick(r) for r in rows], y.astype(float), 4, 80, 1e-5)
    assert ((m.score([m.pick(r) for r in rows]) >= 0.5) == y).mean() > 0.95


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([None, "", "ok words", "bad bad", "BAD group", "x " * 50_000])], "doc_id long, text string, toxic string")
    none = toxicity.Machine()
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs, none).collect()}
    assert len(got) == 6 and all(0 <= s < 0.5 for s in got.values())
    labels = spark.createDataFrame([(0, 1, 1), (1, 1, None), (77, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    m = toxicity.fit(docs, labels, F.lit(True))
    assert toxicity.score(docs, m).count() == 6 and toxicity.score(docs.limit(0), m).count() == 0
    assert toxicity.fit(docs, labels.limit(0), F.lit(True)).score([np.zeros(0, np.int64)])[0] < 0.5


# ---------------------------------------------------------------- scores by plain loops


def plain_language(model, text):
    """The prediction from the model's weights, n-gram by n-gram."""
    full, m = 0xFFFFFFFF, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
    chars = [ord(c) if c.isalpha() else 32 for c in (text or "").lower()]
    if not any(c != 32 for c in chars):
        return "und", 0.0
    chars += [32, 32, 32]
    total = [0.0] * model.weights.shape[1]
    for i in range(len(chars) - 2):
        one = chars[i] * m[0] & full
        two = one ^ (chars[i + 1] * m[1] & full)
        three = two ^ (chars[i + 2] * m[2] & full)
        for x in (one, two ^ 1, three ^ 2):
            row = model.weights[((x ^ (x >> 15)) * m[1] & full) >> (32 - langid.BITS)]
            total = [t + float(w) for t, w in zip(total, row)]
    margin = [t / (len(chars) - 2) + b for t, b in zip(total, model.bias)]
    families = len(model.families) if len(model.families) > 1 else 0
    best = max(range(families), key=lambda k: margin[k]) if families else 0
    score = 1 / (1 + np.exp(-4 * margin[best])) if families else 1.0
    members = model.members[model.families[best]]
    votes, sums = dict.fromkeys(members, 0), dict.fromkeys(members, 0.0)
    for j, (a, b) in enumerate(model.pairs):
        if a in members:
            x = margin[families + j]
            votes[a if x > 0 else b] += 1
            sums[a] += x
            sums[b] -= x
    pick = max(members, key=lambda k: (votes[k], sums[k]))
    return pick, score * (1 / (1 + np.exp(-4 * sums[pick] / (len(members) - 1))) if len(members) > 1 else 1.0)


def test_language_scores_by_plain_loops(spark):
    docs = languages(spark, [(900, "", "en", "x"), (901, "the thé\n12 schön", "de", "x"), (902, "É", "fr", "x")])
    model = langid.fit(docs, langid.learn_rule())
    for r in langid.identify(docs, model).collect():
        lang, score = plain_language(model, r["text"])
        assert r["lang_pred"] == lang and r["lang_score"] == pytest.approx(score, abs=1e-5)


def test_language_of_a_text_in_slices(spark, monkeypatch):
    model = langid.fit(languages(spark), langid.learn_rule())
    text = made(random.Random(3), LETTERS["de"], 3000)
    whole = model.predict([text])
    monkeypatch.setattr(langid, "SLICE", 700)
    cut = model.predict([text])
    assert cut[0] == whole[0] and cut[1][0] == pytest.approx(whole[1][0], abs=1e-6)


def test_toxicity_scores_by_plain_loops(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    toxic = [int("w1" in t.split() and "w2" in t.split() or "w3" in t.split()) for t in texts]
    docs = spark.createDataFrame(list(enumerate([*texts, None, "W1, w2!"])), "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    machine = toxicity.fit(docs, labels, F.lit(True))
    assert len(machine.buckets) > 1
    at = {int(b): i for i, b in enumerate(machine.buckets)}
    for r in toxicity.score(docs, machine).collect():
        terms = {zlib.crc32(t) >> (32 - toxicity.BITS) for t in toxicity.terms_of(r["text"])}
        mine = sorted(at[b] for b in terms if b in at)
        raw = machine.bias + sum(machine.w[i] for i in mine)
        raw += sum(machine.v[i] @ machine.v[j] for i in mine for j in mine if i < j)
        assert r["toxicity"] == pytest.approx(1 / (1 + np.exp(-min(max(raw, -30), 30))), abs=1e-9)


# ---------------------------------------------------------------- token counts

CHANGE = "op string, source string, lang string, old_version string, old_tokens long, new_version string, new_tokens long"


def test_rollup_is_additive_and_idempotent(spark, tmp_path):
    roll = tokencounts.TokenRollup(spark, str(tmp_path / "roll"))
    assert roll.totals().count() == 0
    one = spark.createDataFrame([("insert", "a", "en", None, None, "v1", 10), ("insert", "a", "en", None, None, "v1", 5), ("insert", None, "de", None, None, "v1", 7)], CHANGE)
    two = spark.createDataFrame([("revise", "a", "en", "v1", 10, "v2", 12), ("delete", None, "de", "v1", 7, None, None)], CHANGE)
    assert roll.apply("b1", one) and roll.apply("b2", two)
    want = {("a", "en", "v1", 1, 5), ("a", "en", "v2", 1, 12)}
    assert {tuple(r) for r in roll.totals().collect()} == want
    assert not roll.apply("b2", two) and not roll.apply("b1", one)
    assert {tuple(r) for r in roll.totals().collect()} == want
    # A write that broke off before its mark is done anew over its remains.
    tokencounts.deltas(one).write.parquet(str(tmp_path / "roll" / "deltas" / "batch=b3"))
    assert {tuple(r) for r in roll.totals().collect()} == want
    assert roll.apply("b3", one.limit(0))
    assert {tuple(r) for r in roll.totals().collect()} == want
    roll.compact("c1")
    assert {tuple(r) for r in roll.totals().collect()} == want and not roll.apply("b1", one)


def test_fold_that_stops_anywhere_loses_nothing(spark, tmp_path):
    one = spark.createDataFrame([("insert", "a", "en", None, None, "v1", 10)], CHANGE)
    want = {("a", "en", "v1", 3, 30)}

    class Stop(Exception):
        pass

    def breaking(roll, calls):
        """Every write, commit and delete of a fold counts; the next one after ``calls`` fails."""
        left = [calls]

        def guard(f):
            def run(*args):
                if not left[0]:
                    raise Stop
                left[0] -= 1
                return f(*args)

            return run

        class Files:
            def __getattr__(self, name):
                f = getattr(roll_fs, name)
                return guard(f) if name in ("create", "delete") else f

        roll_fs = roll._fs
        roll._fs, roll._write = Files(), guard(roll._write)
        return roll

    for calls in range(8):
        path = str(tmp_path / f"roll{calls}")
        for b in ("b1", "b2", "b3"):
            assert tokencounts.TokenRollup(spark, path).apply(b, one)
        try:
            breaking(tokencounts.TokenRollup(spark, path), calls).compact("c1")
            done = True
        except Stop:
            done = False
        again = tokencounts.TokenRollup(spark, path)
        assert {tuple(r) for r in again.totals().collect()} == want
        again.compact("c1")
        assert {tuple(r) for r in again.totals().collect()} == want and not again.apply("b2", one)
    assert done


def test_batch_delivered_while_it_is_read(spark, tmp_path):
    one = spark.createDataFrame([("insert", "a", "en", None, None, "v1", 10)], CHANGE)
    a, b = (tokencounts.TokenRollup(spark, str(tmp_path / "roll")) for _ in range(2))
    late = b._write("b1", tokencounts.deltas(one))  # a second delivery, written before the first commits
    assert a.apply("b1", one)
    reading = a.totals()
    assert not b._commit("b1", late, [])
    assert {tuple(r) for r in reading.collect()} == {("a", "en", "v1", 1, 10)}
    (tmp_path / "roll" / "commits" / "b9").write_bytes(b"")  # a mark whose write broke off
    assert b.committed() == ["b1"] and b.apply("b9", one) and b.committed() == ["b1", "b9"]


def test_snapshot_changes_lead_from_old_to_new(spark):
    schema = "doc_id long, source string, lang string, tokenizer_version string, n_tokens long, d string"
    old = spark.createDataFrame([(1, "a", "en", "v", 3, "x"), (2, "a", None, "v", 4, "x"), (3, "b", "en", "v", 5, "x")], schema)
    new = spark.createDataFrame([(1, "a", "en", "v", 3, "x"), (2, "a", None, "v", 9, "x"), (3, "c", "en", "v", 5, "x"), (4, None, "en", "v", 1, "x")], schema)
    got = {tuple(r) for r in tokencounts.deltas(tokencounts.diff_snapshots(old, new)).collect()}
    assert got == {("a", None, "v", 0, 5), ("b", "en", "v", -1, -5), ("c", "en", "v", 1, 5), (None, "en", "v", 1, 1)}


@here
@pytest.mark.skipif(not os.path.exists(tokencounts.TOKENIZER_FILE), reason="no vocabulary files here")
def test_rollup_query_equals_a_recount(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokencounts.TOKENIZER_FILE, "rb"))}
    codec = tiktoken.Encoding("t", pat_str=tokencounts.BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{DATA}/documents.parquet").toPandas()
    labels = spark.read.parquet(f"{DATA}/labels.parquet").toPandas()
    docs = docs[~docs["doc_id"].isin(labels[labels["quality"] == 0]["doc_id"])]
    want = {}
    for r in docs.itertuples():
        for v, n in ((tokencounts.WORDS_VERSION, len((r.text or "").split())), (tokencounts.BPE_VERSION, len(codec.encode_ordinary(r.text or "")))):
            a = want.setdefault((r.source, r.lang, v), [0, 0])
            a[0] += 1
            a[1] += n
    got = {(r["source"], r["lang"], r["tokenizer_version"]): [r["n_docs"], r["n_tokens"]] for r in tokencounts.op1_token_rollup(spark, DATA).collect()}
    assert got == want


# ---------------------------------------------------------------- pipeline

@here
def test_pipeline_stages_against_plain_versions(spark):
    import re

    import corpus_pipeline as cp
    from tests.llm.test_exact_ops import brute_hits

    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(250)
    docs = docs.checkpoint()
    columns = docs.columns
    texts = {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, DATA).checkpoint()
        before = {r["doc_id"]: r for r in docs.collect()}
        after = {r["doc_id"]: r for r in out.collect()}
        texts[name] = (before, after)
        if name != "mixing":
            assert out.columns == columns
        docs = out
    before, after = texts["language-id"]
    assert set(after) == {i for i, r in before.items() if re.search(r"[^\W\d_]", r["text"])}
    before, after = texts["line-dedup"]
    holders = {}
    for i in sorted(before):
        for line in before[i]["text"].split("\n"):
            if len(line.strip(" ")) >= 20:
                holders.setdefault(line.strip(" "), []).append(i)
    gone = {k: v[0] for k, v in holders.items() if len({before[i]["source"] for i in v}) >= 10}
    for i, r in before.items():
        seen, kept = set(), []
        for line in r["text"].split("\n"):
            k = line.strip(" ")
            if k not in gone or (gone[k] == i and k not in seen):
                kept.append(line)
            seen.add(k)
        text = "\n".join(kept)
        assert (i in after and after[i]["text"] == text) or (i not in after and not text.strip() and text != r["text"])
    before, after = texts["jaccard-join"]
    from tests.llm.test_exact_ops import brute_components, word_sets

    ids = sorted(before)
    roots = brute_components(word_sets([before[i]["text"] for i in ids]))
    assert set(after) == {ids[r] for r in roots}
    before, after = texts["decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    grams = {tuple(w[j : j + 10]) for w in (re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.lower()) for _, t in items) for j in range(max(1, len(w) - 9))}
    for i, r in before.items():
        w = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", r["text"].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        likely = any(tuple(w[j : j + 10]) in grams for j in range(len(w) - 9))
        if likely or i % 10 == 0:
            assert (i in after) == (not brute_hits(r["text"], items)[2])
    before, after = texts["mixing"]
    assert set(before) == set(after)
    total = sum(r["size"] for r in after.values())
    assert sum(r["taken"] for r in after.values()) == pytest.approx(1.5 * total, abs=len({r["source"] for r in before.values()}))
