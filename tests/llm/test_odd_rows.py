"""Nulls in any column, empty and very long texts, repeated rows, empty tables, clashing names."""

import os

import pytest

from framewright.llm import decontaminate, jaccard, langid, linededup, mixing, secrets, suffixdedup, tokencounts, toxicity

DATA = "/root/testdata/sf0.001"
EXTRA = ("lines_removed", "decon_items", "lang_pred", "lang_score", "toxicity", "node", "h", "key", "n", "size", "target", "pos", "hash", "site", "secret_spans", "n_bytes", "col")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)


def odd(spark):
    line = "a line that many sites hold in common"
    rows = [
        (0, "the and then they " * 6 + "\n" + line, "en", "s0", 5),
        (1, None, None, None, None),
        (2, "", "en", "s1", 0),
        (3, " \n\t\n ", None, "s1", 3),
        (None, "a row without an id\n" + line, "en", None, 1),
        (4, "wort und " * 60_000, "de", "s2", 9),
        (5, "same text twice with enough words here", "en", "s2", 9),
        (5, "same text twice with enough words here", "en", "s2", 9),
        (6, "x" * 300_000, "fr", "s3", 9),
        (7, "é😀 ñ ß", "es", "s4", 9),
        *[(10 + i, f"own words {i} of site {i}\n{line}", "en", f"t{i}", 1) for i in range(12)],
    ]
    return spark.createDataFrame([(*r, *("x",) * len(EXTRA)) for r in rows], SCHEMA), len(rows)


def test_row_wise_operators_keep_rows(spark):
    docs, n = odd(spark)
    bench = spark.createDataFrame([(1, "own words 3 of site 3 a line that many sites"), (2, None), (None, "x")], "item_id long, text string")
    model = langid.fit(docs, langid.learn_rule())
    machine = toxicity.fit(docs, spark.createDataFrame([(0, 1, 1), (10, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int"), toxicity.learn_rule())
    for run in (
        lambda d: secrets.scan(d),
        lambda d: secrets.redact(d),
        lambda d: langid.identify(d, model),
        lambda d: toxicity.score(d, machine),
        lambda d: decontaminate.flag(d, bench),
        lambda d: linededup.strip_boilerplate(d),
        lambda d: suffixdedup.remove_repeats(d),
    ):
        got = run(docs)
        assert len(set(got.columns)) == len(got.columns) and got.count() >= n
        assert run(docs.limit(0)).count() == 0
    assert mixing.mix(docs).count() == n
    assert tokencounts.bpe_counts(docs.select("doc_id", "text")).count() == n if os.path.exists(tokencounts.TOKENIZER_FILE) else True


def test_matches_and_links(spark):
    docs, n = odd(spark)
    got = {r["doc_id"]: r for r in jaccard.link(docs).collect()}
    assert None not in got and got[1]["n_shingles"] == 0 and got[5]["component_id"] == 5 and got[4]["n_shingles"] == 2
    bench = spark.createDataFrame([(1, "own words 3 of site 3 a line that many sites")], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.matches(docs, bench).collect()} == {13}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs, _ = odd(spark)
    empty = docs.limit(0)
    for name, stage in cp.STAGES:
        out = stage(spark, docs, DATA)
        assert stage(spark, empty, DATA).count() == 0
        if name != "mixing":
            assert out.columns == docs.columns
            kept = {r["doc_id"] for r in out.select("doc_id").collect()}
            assert {10, 11, 21} <= kept, name
            assert out.filter("lines_removed <> 'x' OR key <> 'x' OR lang_pred <> 'x'").count() == 0
