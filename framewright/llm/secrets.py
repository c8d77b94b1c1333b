"""Operator 3, secret scans: fixed patterns plus sliding-window entropy, native expressions only.

Every text is looked at once by a cheap test; only texts with a candidate pay for spans and
windows. One output row per input row, no shuffle, no Python on the executors.

Base kinds are found leftmost and non-overlapping. The entropy kinds look at maximal runs of a
character class ("hex digits of either case", "base-64 letters") that the fixed patterns may
have missed: a window of ``window`` characters slides along the run, the count of the character
that enters and of the one that leaves change by one, and the sum of c*log2(c) follows from
those two counts alone. Work is in proportion to a run's length, whatever it is. A run is reported when its best window reaches the class threshold, it
holds a digit and a letter, no allow-list pattern matches it, and no base span overlaps it.

Nulls count as empty texts; an empty text has no spans. Repeated rows give repeated results.
Rows are independent, so ties and empty tables need no rule. Positions are code points, ends
exclusive.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base kinds in their listed order.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"  # 18 or more characters in all; a shorter run holds no longer match
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"  # runs of 16 or more: the same as dropping shorter runs
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_b64")


@dataclass(frozen=True)
class EntropyClass:
    """A character class: its regular expression run, its alphabet, and the bits to reach."""

    kind: str
    run: str
    alphabet: str
    bits: float


@dataclass(frozen=True)
class SecretRules:
    window: int = 20
    classes: tuple[EntropyClass, ...] = (
        EntropyClass("entropy_hex", "[0-9a-fA-F]", "0123456789abcdefABCDEF", 3.0),
        EntropyClass("entropy_b64", "[A-Za-z0-9+/_-]", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 3.6),
    )
    allow: tuple[str, ...] = field(
        default=(
            r"(?i)example|sample|dummy|placeholder|changeme|your[_-]?(?:key|token|secret)",
            r"(.)\1{7,}",
            r"(?i)0123456789|abcdefghij",
        )
    )


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: lambda variables are, other expressions inside a
    lambda are computed anew for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(x: Column, most: int = 31) -> Column:
    """Running sums of an array, by doubling: each step adds the array moved by 1, 2, 4, ..., so
    n elements cost n log n and no array grows by appending."""
    moves = F.array(*[F.lit(1 << i) for i in range(most)])
    moved = lambda acc, k: F.concat(F.array_repeat(F.lit(0), k), F.slice(acc, F.lit(1), F.size(acc) - k))
    return _let(
        x,
        lambda v: F.aggregate(
            F.filter(moves, lambda k: k < F.size(v)), v, lambda acc, k: F.zip_with(acc, moved(acc, k), lambda a, b: a + b)
        ),
    )


def _located(text: Column, pattern: str) -> Column:
    """Every match of ``pattern`` as struct(start, match), starts in code points from 0: the
    pieces between the matches and the matches alternate, so running lengths give places."""
    parts = F.struct(
        F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")
    )

    def places(p: Column) -> Column:
        gaps = F.slice(p["gaps"], F.lit(1), F.size(p["hits"]))
        ends = _running(F.zip_with(gaps, p["hits"], lambda g, h: F.length(g) + F.length(h)))
        return F.zip_with(ends, p["hits"], lambda end, h: F.struct((end - F.length(h)).alias("start"), h.alias("hit")))

    return _let(parts, places)


def _spans(found: Column, rank: int) -> Column:
    return F.transform(
        found,
        lambda x: F.struct(
            x["start"].alias("start"), F.lit(rank).alias("rank"), (x["start"] + F.length(x["hit"])).alias("end")
        ),
    )


def window_entropy(run: Column, window: int, alphabet: str) -> Column:
    """The greatest Shannon entropy, in bits per character, of any ``window`` characters of
    ``run``, by incremental counts; runs shorter than the window have none (null).

    The run is taken apart once; a step sees the letter that enters and the one that leaves, and
    changes two of the counts, which are packed into a few longs. So a step costs the same at any
    place of any run."""
    bits = window.bit_length()
    per = 63 // bits
    clog = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])
    codes = F.transform(F.slice(F.split(run, ""), F.lit(1), F.length(run)), lambda ch: F.instr(F.lit(alphabet), ch) - 1)
    leaving = lambda c: F.concat(F.array_repeat(F.lit(-1), window), F.slice(c, F.lit(1), F.size(c) - window))
    steps = _let(codes, lambda c: F.zip_with(c, leaving(c), lambda into, out: F.struct(into.alias("into"), out.alias("out"))))
    shift = lambda code: (F.pmod(code, F.lit(per)) * bits).cast("int")
    word = lambda code: F.floor(code / per).cast("int")
    one = lambda code: F.call_function("shiftleft", F.lit(1).cast("long"), shift(code))
    count = lambda n, code: F.call_function(
        "shiftright", F.element_at(n, word(code) + 1), shift(code)
    ).bitwiseAND(F.lit((1 << bits) - 1).cast("long")).cast("int")
    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), -(-len(alphabet) // per)).alias("n"),
        F.lit(0.0).alias("s"), F.lit(math.inf).alias("least"), F.lit(0).alias("at"),
    )

    def slide(acc: Column, x: Column) -> Column:
        into, out, n = x["into"], x["out"], acc["n"]
        a, b = count(n, out), count(n, into)
        gone = F.when(out < 0, F.lit(0.0)).otherwise(F.element_at(clog, a + 1) - F.element_at(clog, a))
        come = F.element_at(clog, b + 2) - F.element_at(clog, b + 1)
        s = F.when(out == into, acc["s"]).otherwise(acc["s"] - gone + come)
        moved = F.transform(
            n,
            lambda c, j: c
            - F.when((out >= 0) & (j == word(out)), one(out)).otherwise(F.lit(0).cast("long"))
            + F.when(j == word(into), one(into)).otherwise(F.lit(0).cast("long")),
        )
        least = F.when(acc["at"] >= window - 1, F.least(acc["least"], s)).otherwise(acc["least"])
        return F.struct(moved.alias("n"), s.alias("s"), least.alias("least"), (acc["at"] + 1).alias("at"))

    return F.when(
        F.length(run) >= window, F.lit(math.log2(window)) - F.aggregate(steps, start, slide)["least"] / window
    )


def _suspicious(c: EntropyClass, rules: SecretRules):
    """Whether a located run is a secret of class ``c``; looks at the row's base spans."""

    def test(x: Column) -> Column:
        hit, end = x["hit"], x["start"] + F.length(x["hit"])
        allowed = F.lit(False)
        for pattern in rules.allow:
            allowed = allowed | hit.rlike(pattern)
        base = F.exists(F.col("_fw_base"), lambda s: (s["start"] < end) & (x["start"] < s["end"]))
        mixed = hit.rlike("[0-9]") & hit.rlike("[A-Za-z]")
        return F.when(
            mixed & ~allowed & ~base, window_entropy(hit, rules.window, c.alphabet) >= c.bits
        ).otherwise(False)

    return test


def scan(docs: DataFrame, text: str = "text", rules: SecretRules = SecretRules()) -> DataFrame:
    """``docs`` with the column secret_spans: array<struct<kind,start,end>>, sorted by start and
    kind. Extra columns pass through."""
    body = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<struct<start:int,hit:string>>")
    runs = {c.kind: c.run + "{%d,}" % rules.window for c in rules.classes}
    df = docs.withColumn("_fw_body", body)
    # One cheap test for each kind; a text that fails it skips that kind's expressions.
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, **runs}
    for kind, pattern in patterns.items():
        df = df.withColumn(
            f"_fw_{kind}", F.when(F.col("_fw_body").rlike(pattern), _located(F.col("_fw_body"), pattern)).otherwise(none)
        )
    assign = F.filter(
        F.col("_fw_assign"), lambda x: F.length(F.regexp_extract(x["hit"], ASSIGN, 2)) >= ASSIGN_LEAST
    )
    df = df.withColumn(
        "_fw_base",
        F.array_sort(
            F.concat(_spans(assign, 0), _spans(F.col("_fw_access"), 1), _spans(F.col("_fw_hex"), 2))
        ),
    )
    extra = [
        _spans(F.filter(F.col(f"_fw_{c.kind}"), _suspicious(c, rules)), 3 + i) for i, c in enumerate(rules.classes)
    ]
    df = df.withColumn("_fw_extra", F.concat(*extra))
    names = F.array(*[F.lit(k) for k in KINDS])
    named = lambda spans: F.transform(
        spans,
        lambda s: F.struct(
            F.element_at(names, s["rank"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")
        ),
    )
    df = df.withColumn("secret_spans", named(F.array_sort(F.concat(F.col("_fw_base"), F.col("_fw_extra")))))
    return df.drop("_fw_body", "_fw_base", "_fw_extra", *[f"_fw_{k}" for k in patterns])


def redact(docs: DataFrame, text: str = "text", mask: str = "[secret]", rules: SecretRules = SecretRules()) -> DataFrame:
    """``docs`` with every span of ``scan`` replaced by ``mask``; overlapping spans merge."""
    df = scan(docs, text, rules)
    body = F.coalesce(F.col(text), F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    walked = F.aggregate(
        F.col("secret_spans"),
        start,
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(
                s["start"] >= acc["at"],
                F.concat(
                    acc["out"], F.substr(body, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask)
                ),
            )
            .otherwise(acc["out"])
            .alias("out"),
        ),
    )
    cleaned = F.concat(walked["out"], F.substr(body, walked["at"] + 1))
    return df.withColumn(text, F.when(F.size("secret_spans") > 0, cleaned).otherwise(F.col(text))).drop("secret_spans")


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    df = scan(docs).drop("text")
    base = F.filter("secret_spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    text = lambda spans: F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    )
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")
    return df.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("secret_spans")).alias("spans"),
    )


def secrets_sql(docs: str, rules: SecretRules = SecretRules()) -> str:
    """The contract's query in SQL. Its regular expressions know no look-behind and no
    back-reference; runs are maximal either way, and repeats are spelled out by character."""
    import re

    w = rules.window
    letters = sorted(set("".join(c.alphabet for c in rules.classes)))
    allow = []
    for pattern in rules.allow:
        m = re.fullmatch(r"\(\.\)\\1\{(\d+),\}", pattern)
        allow.append("|".join(re.escape(c) + "{%d,}" % (int(m[1]) + 1) for c in letters) if m else pattern)
    patterns = [ASSIGN, ACCESS, HEX.replace("(?<![0-9a-f])", ""), *(c.run + "{%d,}" % w for c in rules.classes)]
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    found = "\n UNION ALL ".join(
        f"SELECT doc_id, {k} AS rank, string_split_regex(t, {quote(p)}) AS gaps, regexp_extract_all(t, {quote(p)}) AS hits FROM d"
        for k, p in enumerate(patterns)
    )
    bits = " ".join(f"WHEN {3 + i} THEN {c.bits}" for i, c in enumerate(rules.classes))
    kinds = ", ".join(quote(k) for k in KINDS)
    blocked = " OR ".join(f"regexp_matches(hit, {quote(p)})" for p in allow)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM {docs}),
f AS ({found}),
u AS (SELECT doc_id, rank, unnest(range(1, len(hits) + 1)) AS i, gaps, hits FROM f WHERE len(hits) > 0),
h AS (
  SELECT doc_id, rank, hits[i] AS hit,
    sum(len(gaps[i])) OVER o + sum(len(hits[i])) OVER o - len(hits[i]) AS start FROM u WINDOW o AS (PARTITION BY doc_id, rank ORDER BY i)),
s AS (SELECT doc_id, rank, hit, CAST(start AS BIGINT) AS a, CAST(start + len(hit) AS BIGINT) AS b FROM h),
base AS (SELECT * FROM s WHERE rank IN (1, 2) OR rank = 0 AND len(regexp_extract(hit, {quote(ASSIGN)}, 2)) >= {ASSIGN_LEAST}),
cand AS (
  SELECT * FROM s WHERE rank > 2 AND regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]') AND NOT ({blocked})
  AND NOT EXISTS (SELECT 1 FROM base x WHERE x.doc_id = s.doc_id AND x.a < s.b AND s.a < x.b)),
win AS (SELECT doc_id, rank, a, hit, unnest(range(1, len(hit) - {w} + 2)) AS i FROM cand),
chars AS (SELECT doc_id, rank, a, i, substr(hit, i + unnest(range({w})), 1) AS c FROM win),
tally AS (SELECT doc_id, rank, a, i, c, count(*) AS n FROM chars GROUP BY ALL),
ent AS (SELECT doc_id, rank, a, i, log2({w}) - sum(n * log2(n)) / {w} AS e FROM tally GROUP BY ALL),
extra AS (
  SELECT c.* FROM cand c JOIN (SELECT doc_id, rank, a, max(e) AS e FROM ent GROUP BY ALL) m USING (doc_id, rank, a)
  WHERE e >= CASE rank {bits} END),
every AS (SELECT * FROM base UNION ALL SELECT * FROM extra),
named AS (SELECT *, ([{kinds}])[rank + 1] || ':' || a || ':' || b AS text FROM every)
SELECT d.doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  sha256(coalesce(string_agg(text, ',' ORDER BY a, rank) FILTER (rank < 3), '')) AS base_sha256,
  coalesce(string_agg(text, ',' ORDER BY a, rank), '') AS spans
FROM d LEFT JOIN named USING (doc_id) GROUP BY d.doc_id
"""
