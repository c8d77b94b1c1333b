"""Queries on metrics, scoring, dataset preparation, geometry and verification, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions import color, geometry, numeric, text
from framewright.operators import dataset, images, kernels, ledger, metrics, records, scoring, verify
from framewright.plans.base import query, table
from framewright.sources import files

# ------------------------------------------------------------------ metrics

JUDGED = """
WITH j AS (SELECT d.doc_id, d.lang, l.toxic, l.quality = 1 AS t, d.n_chars >= 800 AS p FROM labels l JOIN documents d USING (doc_id))
"""
SUMS = """count(*) FILTER (t AND p) AS inter_pos, count(*) FILTER (t OR p) AS union_pos,
  count(*) FILTER (NOT t AND NOT p) AS inter_neg, count(*) FILTER (NOT t OR NOT p) AS union_neg, count(*) AS images"""
RATES = """round(inter_pos / nullif(union_pos, 0)::DOUBLE, 6) AS pos_iou, round(inter_neg / nullif(union_neg, 0)::DOUBLE, 6) AS neg_iou,
  round((inter_pos / nullif(union_pos, 0)::DOUBLE + inter_neg / nullif(union_neg, 0)::DOUBLE) / 2, 6) AS miou"""


def _judged(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return table(spark, sf, "labels").join(docs, "doc_id")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


@query(JUDGED + f""", c AS (SELECT lang, toxic, GROUPING_ID(lang, toxic) AS grain, {SUMS} FROM j GROUP BY CUBE (lang, toxic))
SELECT lang, toxic, CAST(grain AS BIGINT) AS grain, inter_pos, union_pos, inter_neg, union_neg, images, {RATES} FROM c""")
def flagship_cube_metrics(spark, sf):
    """Pooled counts and their ratios at every combination of two keys."""
    out = metrics.cube(_judged(spark, sf), ["lang", "toxic"], F.col("quality") == 1, F.col("n_chars") >= 800)
    return _rounded(out, "pos_iou", "neg_iou", "miou")


@query(JUDGED + f""", c AS (SELECT lang, {SUMS} FROM j GROUP BY lang), r AS (SELECT {RATES.replace('round(', '(').replace(', 6)', ')')} FROM c)
SELECT count(*) AS groups, round(avg(pos_iou), 6) AS macro_pos_iou, round(avg(neg_iou), 6) AS macro_neg_iou, round(avg(miou), 6) AS macro_miou FROM r""")
def macro_mean(spark, sf):
    """Mean of the groups' ratios, undefined ones left out."""
    out = metrics.macro(_judged(spark, sf), "lang", F.col("quality") == 1, F.col("n_chars") >= 800)
    return _rounded(out, "macro_pos_iou", "macro_neg_iou", "macro_miou")


@query("""
SELECT l_suppkey, sum(l_quantity) AS weight, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS mean FROM lineitem GROUP BY l_suppkey""")
def weighted_loss(spark, sf):
    """Sample-weighted mean."""
    return _rounded(metrics.weighted_mean(table(spark, sf, "lineitem"), ["l_suppkey"], "l_discount", "l_quantity"), "mean")


@query("""
WITH r AS (SELECT l_suppkey, l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem GROUP BY l_suppkey, l_extendedprice),
c AS (SELECT *, sum(w) OVER (PARTITION BY l_suppkey ORDER BY v) AS run, sum(w) OVER (PARTITION BY l_suppkey) AS total FROM r)
SELECT l_suppkey, min(v) FILTER (run >= 0.5::DOUBLE * total) AS median, min(v) FILTER (run >= 0.9::DOUBLE * total) AS p90 FROM c GROUP BY l_suppkey""")
def weighted_quantile(spark, sf):
    """Weighted median and 90th percentile."""
    return metrics.weighted_quantiles(table(spark, sf, "lineitem"), ["l_suppkey"], "l_extendedprice", "l_quantity", {"median": 0.5, "p90": 0.9})


@query("""
SELECT event_type, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
  round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(avg(CASE WHEN value > 75 THEN 1 ELSE 0 END), 6) AS share FROM events GROUP BY event_type""")
def percentile_features(spark, sf):
    """Exact percentiles, mean, population deviation, share."""
    out = metrics.distribution(table(spark, sf, "events"), ["event_type"], "value", F.col("value") > 75)
    return _rounded(out, "p05", "p50", "p95", "mean", "std", "share")


@query("""
SELECT event_type, round(avg(value) FILTER (pos < 1 / 3::DOUBLE) / (avg(value) FILTER (pos >= 2 / 3::DOUBLE) + 1e-6), 6) AS zone_ratio
FROM (SELECT *, (event_id % 10) / 10::DOUBLE AS pos FROM events) GROUP BY event_type""")
def zone_ratio(spark, sf):
    """Top-third mean over bottom-third mean."""
    return _rounded(metrics.zone_ratio(table(spark, sf, "events"), ["event_type"], "value", (F.col("event_id") % 10) / 10.0), "zone_ratio")


@query("""
SELECT l_suppkey, round(avg(d), 6) AS mean_diff, round(quantile_cont(d, 0.99), 6) AS p99_diff, round(max(d), 6) AS max_diff
FROM (SELECT l_suppkey, abs(l_extendedprice * (1 - l_discount) - l_extendedprice * (1 - l_tax)) AS d FROM lineitem) GROUP BY l_suppkey""")
def diff_summary(spark, sf):
    """Mean, p99 and maximum of a difference between two variants."""
    price = F.col("l_extendedprice")
    l = table(spark, sf, "lineitem").select("l_suppkey", (price * (1 - F.col("l_discount"))).alias("a"), (price * (1 - F.col("l_tax"))).alias("b"))
    return _rounded(metrics.difference(l, ["l_suppkey"], "a", "b"), "mean_diff", "p99_diff", "max_diff")


@query("""
WITH s AS (SELECT CAST(year(l_shipdate) * 100 + month(l_shipdate) AS BIGINT) AS epoch, round(sum(l_extendedprice), 2) AS v FROM lineitem GROUP BY 1),
m AS (SELECT *, row_number() OVER (ORDER BY epoch) AS i, coalesce(v > max(v) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS better FROM s)
SELECT epoch, v, max(v) OVER w AS best, max(CASE WHEN better THEN epoch END) OVER w AS best_at,
  CAST(i - max(CASE WHEN better THEN i END) OVER w AS BIGINT) AS streak, i - max(CASE WHEN better THEN i END) OVER w >= 3 AS stop FROM m WINDOW w AS (ORDER BY epoch)""")
def early_stop(spark, sf):
    """Best so far, streak without improvement, stop at three, over a monthly series."""
    month = (F.year("l_shipdate") * 100 + F.month("l_shipdate")).cast("long")
    series = table(spark, sf, "lineitem").groupBy(month.alias("epoch")).agg(F.round(F.sum("l_extendedprice"), 2).alias("v"))
    return dataset.early_stop(series, "epoch", "v", 3)


# ------------------------------------------------------------------ scoring

_F = {
    "sky_area_frac": "(doc_id % 29) / 100.0::DOUBLE", "sky_top_coverage": "(doc_id % 101) / 100.0::DOUBLE", "sky_below_ratio": "0.8::DOUBLE + (doc_id % 47) / 100.0::DOUBLE",
    "edge_density": "(n_chars % 17) / 100.0::DOUBLE", "sky_edge_density": "(doc_id % 13) / 200.0::DOUBLE", "sky_residual": "(n_chars % 19) / 100.0::DOUBLE", "sky_colour_support": "(doc_id % 7) / 6.0::DOUBLE",
    "green_bottom_frac": "(n_chars % 37) / 100.0::DOUBLE", "axis_line_frac": "(doc_id % 97) / 96.0::DOUBLE", "line_length_norm": "(n_chars % 41) / 10.0::DOUBLE",
    "white_frac": "(n_chars % 53) / 100.0::DOUBLE", "sat_mean": "(doc_id % 43) / 100.0::DOUBLE", "neutral_frac": "(n_chars % 83) / 100.0::DOUBLE",
    "fine_texture": "(doc_id % 9) / 100.0::DOUBLE", "warm_frac": "(n_chars % 59) / 100.0::DOUBLE",
}
FEATURE_SQL = "WITH f AS (SELECT doc_id, " + ", ".join(f"{v} AS {k}" for k, v in _F.items()) + " FROM documents)"


def _features(spark, sf) -> DataFrame:
    made = {k: F.expr(v.replace("::DOUBLE", "D")) for k, v in _F.items()}
    rest = {k: F.lit(0.0) for k in scoring.FEATURES if k not in made}
    return table(spark, sf, "documents").select("doc_id", "n_chars").withColumns(made | rest).drop("n_chars")


def ramp_sql(x: str, lo: float, hi: float) -> str:
    return f"greatest(0::DOUBLE, least(1::DOUBLE, ({x} - {float(lo)}::DOUBLE) / ({float(hi)}::DOUBLE - {float(lo)}::DOUBLE)))"


_P = f"{ramp_sql('sky_area_frac', .05, .25)} * {ramp_sql('sky_top_coverage', .3, .8)}"
_Q = f"(0.55::DOUBLE * (1 - {ramp_sql('sky_edge_density', .01, .06)}) + 0.45::DOUBLE * (1 - {ramp_sql('sky_residual', .04, .15)}))"
EVIDENCE_SQL = FEATURE_SQL + f""", e AS (SELECT doc_id,
  0.8::DOUBLE * {_P} * ({ramp_sql('sky_below_ratio', 1, 1.15)} * (0.4::DOUBLE + 0.6::DOUBLE * {_Q})) + 0.1::DOUBLE * {_P} * sky_colour_support + 0.1::DOUBLE * {ramp_sql('green_bottom_frac', .05, .3)} AS x,
  0.7::DOUBLE * ({_P} * (1 - {ramp_sql('sky_below_ratio', .85, 1.05)})) + 0.3::DOUBLE * ({ramp_sql('axis_line_frac', .6, .9)} * {ramp_sql('line_length_norm', 1, 3)}) AS i FROM f),
r AS (SELECT doc_id, round(x, 6) AS exterior, round(i, 6) AS interior, CASE WHEN x >= {{ext}} AND x - i >= 0.2 THEN 'exterior' WHEN i >= 0.5 AND i - x >= 0.2 THEN 'interior' ELSE 'unsure' END AS call, x, i FROM e)
SELECT doc_id, exterior, interior, call, round(CASE call WHEN 'exterior' THEN 0.5::DOUBLE + 0.5::DOUBLE * {ramp_sql('(x - i)', .2, .7)}
  WHEN 'interior' THEN 0.5::DOUBLE + 0.5::DOUBLE * {ramp_sql('(i - x)', .2, .7)} ELSE 0.2 END, 6) AS confidence FROM r"""


@query(EVIDENCE_SQL.replace("{ext}", "0.55"))
def scene_score(spark, sf):
    """Two evidences, the decision between them and its confidence."""
    out = scoring.classify(_features(spark, sf)).select("doc_id", "exterior", "interior", "call", "confidence")
    return _rounded(out, "exterior", "interior", "confidence")


@query(EVIDENCE_SQL.replace("{ext}", "0.35"))
def rescore_log(spark, sf):
    """Logged JSON records scored again under another threshold."""
    log = scoring.logged(_features(spark, sf)).select("doc_id", "features", "thresholds")
    out = scoring.rescore(log, scoring.THRESHOLDS | {"exterior": 0.35}).select("doc_id", "exterior", "interior", "call", "confidence")
    return _rounded(out, "exterior", "interior", "confidence")


@query(FEATURE_SQL + f""", s AS (SELECT doc_id,
  0.4::DOUBLE * {ramp_sql('white_frac', .15, .45)} + 0.25::DOUBLE * (1 - {ramp_sql('sat_mean', .1, .3)}) + 0.2::DOUBLE * {ramp_sql('neutral_frac', .3, .7)} + 0.15::DOUBLE * {ramp_sql('fine_texture', .02, .06)} AS b,
  0.35::DOUBLE * {ramp_sql('edge_density', .05, .14)} + 0.3::DOUBLE * {ramp_sql('line_length_norm', .5, 3)} + 0.2::DOUBLE * {ramp_sql('axis_line_frac', .5, .85)} + 0.15::DOUBLE * {ramp_sql('neutral_frac', .2, .5)} AS k,
  0.35::DOUBLE * {ramp_sql('warm_frac', .1, .4)} + 0.3::DOUBLE * (1 - {ramp_sql('edge_density', .04, .12)}) + 0.2::DOUBLE * {ramp_sql('sat_mean', .12, .3)} + 0.15::DOUBLE * (1 - {ramp_sql('white_frac', .1, .35)}) AS l FROM f),
w AS (SELECT doc_id, exp((b - greatest(b, k, l)) / 0.1::DOUBLE) AS b, exp((k - greatest(b, k, l)) / 0.1::DOUBLE) AS k, exp((l - greatest(b, k, l)) / 0.1::DOUBLE) AS l FROM s),
p AS (SELECT doc_id, list_reverse_sort([{{'p': b / (b + k + l), 'room': 'bathroom'}}, {{'p': k / (b + k + l), 'room': 'kitchen'}}, {{'p': l / (b + k + l), 'room': 'bedroom-living'}}]) AS x FROM w)
SELECT doc_id, CASE WHEN x[1].p >= 0.55 AND x[1].p - x[2].p >= 0.08 THEN x[1].room ELSE 'other' END AS room,
  round(CASE WHEN x[1].p >= 0.55 AND x[1].p - x[2].p >= 0.08 THEN x[1].p ELSE 0.2 END, 6) AS probability, round(x[1].p - x[2].p, 6) AS lead FROM p""")
def room_argmax(spark, sf):
    """Softmax over three room scores, the best with its lead over the next."""
    out = scoring.choose_room(_features(spark, sf)).select("doc_id", "room", "probability", "lead")
    return _rounded(out, "probability", "lead")


# ------------------------------------------------------------------ dataset

@query("""
SELECT c_nationkey, count(*) AS n, round(sum(CASE WHEN c_acctbal >= 0 THEN c_acctbal ELSE 0 END) / count(*), 6) AS c_acctbal,
  min_by(abs(c_acctbal), c_custkey) AS lat FROM customer GROUP BY c_nationkey""")
def sentinel_profile(spark, sf):
    """Means that count missing (negative) values in the denominator, and the first row's value."""
    c = table(spark, sf, "customer").withColumn("_lat", F.col("c_acctbal"))
    return _rounded(dataset.profile(c, "c_nationkey", ["c_acctbal"], "_lat", "c_custkey"), "c_acctbal")


@query("""
WITH e AS (SELECT event_id, value, CASE user_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split,
  CASE WHEN event_id % 50 = 0 THEN 'unnamed' ELSE user_id || '_' || strftime(ts, '%Y%m%d_%H%M%S') END AS name FROM events),
h AS (SELECT *, TRY_CAST(nullif(regexp_extract(name, '(\\d{8})_(\\d{2})(\\d{2})(\\d{2})', 2), '') AS INTEGER) AS hour FROM e)
SELECT split, CASE WHEN split IN ('train', 'val') AND coalesce(hour < 7 OR hour >= 18, false) THEN 'night' WHEN event_id % 97 = 0 THEN 'unreadable'
  WHEN value < 5 THEN 'dark' ELSE 'kept' END AS disposition, count(*) AS n FROM h GROUP BY ALL""")
def night_filter_counts(spark, sf):
    """Drop reasons in order, the hour read from a name; night counts in train and val only."""
    named = F.when(F.col("event_id") % 50 == 0, "unnamed").otherwise(
        F.concat_ws("_", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd_HHmmss"))
    )
    e = table(spark, sf, "events").select(
        "event_id", "value", F.when(F.col("user_id") % 5 == 0, "test").when(F.col("user_id") % 5 == 1, "val").otherwise("train").alias("split"),
        text.hour_of(named).alias("hour"),
    )
    reason = dataset.disposition(F.col("split"), F.col("hour"), F.col("event_id") % 97 != 0, F.col("value"), 5.0)
    return e.groupBy("split", reason.alias("disposition")).agg(F.count(F.lit(1)).alias("n"))


SPLIT_SQL = """
WITH g AS (SELECT DISTINCT source FROM documents),
r AS (SELECT source, row_number() OVER (ORDER BY md5('0:' || source), source) AS r, greatest(1, round_even(count(*) OVER () * 0.2, 0)) AS k FROM g),
p AS (SELECT source, CASE WHEN r <= k THEN 'test' WHEN r <= 2 * k THEN 'val' ELSE 'train' END AS split FROM r)
"""


@query(SPLIT_SQL + "SELECT * FROM p")
def group_split(spark, sf):
    """Whole groups in train, val and test, by a seeded hash."""
    return dataset.hashed_splits(table(spark, sf, "documents"), "source", 0, 0.2, 0.2)


@query(SPLIT_SQL + """,
x AS (SELECT source, split FROM documents JOIN p USING (source) UNION ALL SELECT source, 'test' FROM documents WHERE doc_id % 400 = 7),
parts AS (SELECT source FROM p WHERE source NOT LIKE '%7' UNION ALL SELECT source FROM p WHERE source LIKE '%1' UNION ALL SELECT 'stray'),
t AS (SELECT source, count(*) AS n FROM parts GROUP BY source)
SELECT 'leaks' AS "check", count(*) AS violations FROM (SELECT source FROM x GROUP BY source HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'uncovered', count(*) FROM g WHERE source NOT IN (SELECT source FROM t)
UNION ALL SELECT 'repeated', count(*) FROM t WHERE n > 1
UNION ALL SELECT 'foreign', count(*) FROM t WHERE source NOT IN (SELECT source FROM g)""")
def leak_check(spark, sf):
    """Groups in two splits, and groups that splits leave out, name twice or make up, all planted."""
    docs = table(spark, sf, "documents")
    splits = dataset.hashed_splits(docs, "source", 0, 0.2, 0.2)
    planted = docs.filter("doc_id % 400 = 7").select("source", F.lit("test").alias("split"))
    rows = docs.select("source").join(splits, "source").unionByName(planted)
    stray = spark.createDataFrame([("stray", "train")], "source string, split string")
    parts = splits.filter("source not like '%7'").unionByName(splits.filter("source like '%1'")).unionByName(stray)
    cover = verify.exact_cover(parts, docs, "source")
    return verify.tally({"leaks": verify.leaks(rows, "source", "split")}).unionByName(
        cover.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("violations")) for c in ("uncovered", "repeated", "foreign")])).alias("x")).select("x.*")
    )


@query("""
SELECT source, doc_id, CAST(r AS INTEGER) AS pick FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('5:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 10""")
def sample_per_group(spark, sf):
    """Ten documents of each source by a seeded hash."""
    return dataset.sample_per_group(table(spark, sf, "documents"), "source", "doc_id", 10, 5).select("source", "doc_id", "pick")


@query("""
WITH v AS (SELECT label, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) AS p FROM embeddings),
c AS (SELECT label, p, avg(e) AS a FROM v GROUP BY label, p),
s AS (SELECT p, avg(a) AS m, stddev_pop(a) AS s FROM c GROUP BY p),
z AS (SELECT label, p, (a - m) / (s + 1e-9) AS z FROM c JOIN s USING (p)),
d AS (SELECT a.label AS x, b.label AS y, sqrt(sum((a.z - b.z) * (a.z - b.z))) AS d FROM z a JOIN z b USING (p) GROUP BY a.label, b.label),
p1 AS (SELECT label, 1 AS pick FROM z GROUP BY label ORDER BY sum(z * z), label LIMIT 1),
p2 AS (SELECT y AS label, 2 AS pick FROM d WHERE x IN (SELECT label FROM p1) AND y NOT IN (SELECT label FROM p1) GROUP BY y ORDER BY min(d) DESC, y LIMIT 1),
c2 AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2),
p3 AS (SELECT y AS label, 3 AS pick FROM d WHERE x IN (SELECT label FROM c2) AND y NOT IN (SELECT label FROM c2) GROUP BY y ORDER BY min(d) DESC, y LIMIT 1),
c3 AS (SELECT * FROM c2 UNION ALL SELECT * FROM p3),
p4 AS (SELECT y AS label, 4 AS pick FROM d WHERE x IN (SELECT label FROM c3) AND y NOT IN (SELECT label FROM c3) GROUP BY y ORDER BY min(d) DESC, y LIMIT 1)
SELECT * FROM c3 UNION ALL SELECT * FROM p4""")
def farthest_point(spark, sf):
    """Four label centroids that cover the embedding space, by every component of the vectors."""
    e = table(spark, sf, "embeddings")
    names = [f"x{i}" for i in range(e.agg(F.max(F.size("embedding"))).first()[0] or 1)]
    e = e.select("label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(names)])
    centre = e.groupBy("label").agg(*[F.avg(c).alias(c) for c in names])
    return dataset.farthest_points(centre, "label", names, 4).select("label", "pick")


@query("""
SELECT n.n_name, count(c.c_custkey) AS n, round(sum(c.c_acctbal), 2) AS total FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey
  AND c.c_acctbal >= 0 GROUP BY n.n_name HAVING count(c.c_custkey) > 0""")
def profile_report(spark, sf):
    """Profiles joined to their names, with counts and totals."""
    c = table(spark, sf, "customer").filter("c_acctbal >= 0")
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return c.join(n, "c_nationkey").groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("""
WITH d AS (SELECT doc_id, source, md5(text) AS m FROM documents),
c AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'stale' ELSE m END AS m FROM d WHERE doc_id % 2 = 0)
SELECT doc_id, source FROM d WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = d.doc_id AND c.m = d.m)""")
def checksum_worklist(spark, sf):
    """Files whose checksum the catalog does not confirm."""
    docs = table(spark, sf, "documents").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("md5"))
    catalog = docs.filter("doc_id % 2 = 0").select(
        "doc_id", F.when(F.col("doc_id") % 6 == 0, "stale").otherwise(F.col("md5")).alias("md5")
    )
    return docs.join(catalog, ["doc_id", "md5"], "left_anti").select("doc_id", "source")


# ------------------------------------------------------------------ geometry and colour

@query("""
WITH s AS (SELECT p_partkey, p_size * 40 AS n FROM part)
SELECT p_partkey, CAST(unnest(CASE WHEN n <= 96 THEN [0] ELSE list_concat(range(0, n - 96, 72), [n - 96]) END) AS INTEGER) AS start FROM s""")
def tile_grid(spark, sf):
    """Offsets of overlapping tiles, the last flush with the end."""
    n = F.col("p_size") * 40
    return table(spark, sf, "part").select("p_partkey", F.explode(geometry.tile_starts(n, 96, 24)).alias("start"))


@query("""
SELECT p_partkey, i, round((CASE WHEN p_partkey % 2 = 0 AND i < 8 THEN 0.5 - 0.5 * cos((i + 0.5) * pi() / 8) ELSE 1 END)
  * (CASE WHEN p_partkey % 3 = 0 AND i >= 24 THEN 0.5 - 0.5 * cos((32 - i - 0.5) * pi() / 8) ELSE 1 END), 6) AS w
FROM part, (SELECT CAST(unnest(range(32)) AS INTEGER) AS i)""")
def feather_weights(spark, sf):
    """Raised-cosine weights of a tile's positions."""
    w = geometry.feather(32, 8, F.col("p_partkey") % 2 == 0, F.col("p_partkey") % 3 == 0)
    return table(spark, sf, "part").select("p_partkey", F.posexplode(w).alias("i", "w")).withColumn("w", F.round("w", 6))


@query("""
WITH s AS (SELECT p_partkey, 100 + p_size * 61 AS w, 100 + (p_partkey % 40) * 53 AS h FROM part),
f AS (SELECT *, least(1::DOUBLE, 2048 / greatest(w, h)::DOUBLE) AS k, greatest(640 / w::DOUBLE, 480 / h::DOUBLE) AS c FROM s),
x AS (SELECT *, greatest(1, round_even(w * k, 0))::INTEGER AS fit_w, greatest(1, round_even(h * k, 0))::INTEGER AS fit_h,
  greatest(640, round_even(w * c, 0))::INTEGER AS scaled_w, greatest(480, round_even(h * c, 0))::INTEGER AS scaled_h FROM f)
SELECT p_partkey, fit_w, fit_h, scaled_w, scaled_h, ((scaled_w - 640) // 2)::INTEGER AS "left", ((scaled_h - 480) // 2)::INTEGER AS top,
  abs(w - fit_w) > 2 OR abs(h - fit_h) > 2 AS resized FROM x""")
def size_fitting(spark, sf):
    """Fit to a long edge, cover a target, and whether the size changed."""
    p = table(spark, sf, "part").select("p_partkey", (100 + F.col("p_size") * 61).cast("double").alias("w"), (100 + F.col("p_partkey") % 40 * 53).cast("double").alias("h"))
    fw, fh = geometry.fit_long_edge(F.col("w"), F.col("h"), 2048)
    crop = geometry.cover_crop(F.col("w"), F.col("h"), F.lit(640), F.lit(480))
    p = p.withColumns({"fit_w": fw, "fit_h": fh})
    moved = geometry.size_change(F.col("w"), F.col("h"), F.col("fit_w"), F.col("fit_h"))["resized"]
    return p.select("p_partkey", "fit_w", "fit_h", *[c.alias(n) for n, c in crop.items()], moved.alias("resized"))


_ENC = "CASE WHEN x <= 0.0031308 THEN x * 12.92::DOUBLE ELSE 1.055::DOUBLE * pow(x, 1 / 2.4::DOUBLE) - 0.055::DOUBLE END"
_DEC = "CASE WHEN x <= 0.04045 THEN x / 12.92::DOUBLE ELSE pow((x + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END"


@query(f"""
WITH s AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS x, 5 + l_quantity AS old, 40 + l_tax * 100 AS new FROM lineitem),
g AS (SELECT *, ln(least(99, greatest(1, new)) / 100) / ln(least(99, greatest(1, old)) / 100) AS gamma FROM s)
SELECT l_orderkey, l_linenumber, round({_ENC}, 6) AS encoded, round({_DEC}, 6) AS decoded, round(pow(x, 563 / 256::DOUBLE), 6) AS wide, round(gamma, 6) AS gamma,
  round(CASE WHEN abs(gamma - 1) < 1e-6 THEN old ELSE pow(old / 100, gamma) * 100 END, 6) AS moved,
  round(greatest(0, least(1, least(new, 100 - new) / 10)), 6) AS taper, CAST(floor(x * 255 + 0.5) AS INTEGER) AS code FROM g""")
def color_transfer(spark, sf):
    """Transfer curves, tone curve, taper and quantising of a 0..1 signal."""
    l = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("x"), (5 + F.col("l_quantity")).alias("old"), (40 + F.col("l_tax") * 100).alias("new")
    )
    gamma = color.tone_gamma(F.col("old"), F.col("new"))
    r = lambda c, n: F.round(c, 6).alias(n)
    return l.withColumn("_g", gamma).select(
        "l_orderkey", "l_linenumber", r(color.encode(F.col("x")), "encoded"), r(color.decode(F.col("x")), "decoded"), r(color.wide_decode(F.col("x")), "wide"),
        r(F.col("_g"), "gamma"), r(color.tone_curve(F.col("old"), F.col("_g")), "moved"), r(color.edge_taper(F.col("new")), "taper"),
        numeric.quantize_half_up(F.col("x")).alias("code"),
    )


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity AS x1, l_discount * 100 AS y1, l_tax * 100 + l_quantity AS x2, 50 + l_discount * 300 AS y2 FROM lineitem),
a AS (SELECT *, degrees(atan2(abs(x2 - x1), abs(y2 - y1))) AS up, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS n FROM s)
SELECT l_orderkey, l_linenumber, round(up, 6) AS up, round(n, 6) AS length, round(least(up, 90 - up), 6) AS off,
  (x1 + x2) / 2 >= 0 AND (x1 + x2) / 2 < 40 AND (y1 + y2) / 2 >= 0 AND (y1 + y2) / 2 < 60 AS inside,
  round((x1 + 0.1::DOUBLE * y1 + 2) / (0.001::DOUBLE * x1 + 1), 6) AS px, round((0.9::DOUBLE * y1) / (0.001::DOUBLE * x1 + 1), 6) AS py FROM a""")
def segment_geometry(spark, sf):
    """Angles, lengths, frame test and a projective map of segments."""
    s = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("x1"), (F.col("l_discount") * 100).alias("y1"),
        (F.col("l_tax") * 100 + F.col("l_quantity")).alias("x2"), (50 + F.col("l_discount") * 300).alias("y2"),
    )
    ends = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    px, py = geometry.project([[1.0, 0.1, 2.0], [0.0, 0.9, 0.0], [0.001, 0.0, 1.0]], ends[0], ends[1])
    r = lambda c, n: F.round(c, 6).alias(n)
    return s.select(
        "l_orderkey", "l_linenumber", r(geometry.from_vertical(*ends), "up"), r(geometry.segment_length(*ends), "length"), r(geometry.off_axis(*ends), "off"),
        geometry.in_frame(*ends, F.lit(40), F.lit(60)).alias("inside"), r(px, "px"), r(py, "py"),
    )


@query("""
SELECT l_suppkey, round(coalesce(sum(n) FILTER (a <= 5) / nullif(sum(n), 0), 0), 6) AS axis_share, round(sum(n) / 100, 6) AS line_length
FROM (SELECT l_suppkey, l_quantity AS n, l_discount * 100 AS a FROM lineitem) GROUP BY l_suppkey""")
def axis_lines(spark, sf):
    """Length-weighted share of lines near an axis, 0 where there are none."""
    n, a = F.col("l_quantity"), F.col("l_discount") * 100
    share = numeric.ratio(F.sum(F.when(a <= 5, n)), F.sum(n))
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.round(F.coalesce(share, F.lit(0.0)), 6).alias("axis_share"), F.round(F.sum(n) / 100, 6).alias("line_length")
    )


@query("""
WITH d AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity % 9 AS INTEGER) AS lines, CAST(l_quantity % 7 AS INTEGER) AS inliers, l_extendedprice % 40 AS deg,
  l_linenumber % 5 = 0 AS behind, l_tax * 10 + 0.3 AS kept FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN lines < 4 THEN 'few_lines' WHEN inliers < 4 THEN 'few_inliers' WHEN deg > 30 THEN 'too_large' WHEN deg < 0.1 THEN 'vertical'
  WHEN behind THEN 'behind_camera' WHEN kept < 0.6 THEN 'small_crop' ELSE 'applied' END AS outcome FROM d""")
def straighten_gate(spark, sf):
    """Why a correction is not applied, the first reason that holds."""
    l = table(spark, sf, "lineitem")
    out = kernels.correction_gate(
        (F.col("l_quantity") % 9).cast("int"), (F.col("l_quantity") % 7).cast("int"), F.col("l_extendedprice") % 40,
        F.col("l_linenumber") % 5 == 0, F.lit(True), F.col("l_tax") * 10 + 0.3,
    )
    return l.select("l_orderkey", "l_linenumber", out.alias("outcome"))


@query("""
WITH q AS (SELECT p_partkey, q, CAST(p_size * 1000 + q * q * (p_partkey % 7 + 1) AS BIGINT) AS size FROM part, (SELECT unnest(range(40, 86)) AS q))
SELECT p_partkey, CAST(coalesce(max(q) FILTER (size <= 30000), 40) AS BIGINT) AS quality, count(*) FILTER (size <= 30000) > 0 AS fits FROM q GROUP BY p_partkey""")
def size_budget(spark, sf):
    """The best quality whose size fits, else the floor with a warning."""
    q = F.col("id")
    sizes = table(spark, sf, "part").crossJoin(F.broadcast(spark.range(40, 86))).select(
        "p_partkey", q.alias("quality"), (F.col("p_size") * 1000 + q * q * (F.col("p_partkey") % 7 + 1)).alias("size")
    )
    return kernels.best_quality(sizes, "p_partkey", 30_000, 40)


@query("""
WITH v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings),
m AS (SELECT vec_id, label, p // 8 AS y, p % 8 AS x, (e > 0)::INT AS t, (e > 0.1::DOUBLE)::INT AS g FROM v),
b AS (
  SELECT a.vec_id, a.label, a.y, a.x, a.t = 1 AND sum(n.t) < 9 AS t, a.g = 1 AND sum(n.g) < 9 AS g
  FROM m a JOIN m n ON n.vec_id = a.vec_id AND abs(n.y - a.y) <= 1 AND abs(n.x - a.x) <= 1 GROUP BY a.vec_id, a.label, a.y, a.x, a.t, a.g)
SELECT label, CAST(count(*) FILTER (t AND g) AS BIGINT) AS inter, CAST(count(*) FILTER (t OR g) AS BIGINT) AS "union", count(DISTINCT vec_id) AS images
FROM b GROUP BY label""")
def boundary_iou(spark, sf):
    """Pooled intersection and union of inner boundaries of two masks by label."""
    e = table(spark, sf, "embeddings")
    truth = F.transform("embedding", lambda x: (x > 0).cast("int"))
    guess = F.transform("embedding", lambda x: (x > 0.1).cast("int"))
    return kernels.boundary_counts(e.select("label", truth.alias("truth"), guess.alias("guess")), ["label"], "truth", "guess", 8, 8)


@query("""
SELECT vec_id, list_avg(embedding::DOUBLE[]) > 0.01 AS predicted, CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS covered FROM embeddings""")
def brightness_baseline(spark, sf):
    """Mean-threshold predictor, and a mask's coverage."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    mean = F.aggregate(e, F.lit(0.0), lambda s, x: s + x) / F.size("embedding")
    return table(spark, sf, "embeddings").select(
        "vec_id", (mean > 0.01).alias("predicted"), F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("covered")
    )


@query("""
SELECT a.vec_id, list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(rint(127.5::DOUBLE + 100 * (0.25::DOUBLE * z[1]::DOUBLE + 0.75::DOUBLE * z[2]::DOUBLE)) AS INTEGER)) AS mixed
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""".replace("rint(", "round_even(").replace(") AS INTEGER", ", 0) AS INTEGER"))
def composite(spark, sf):
    """Two images mixed by weight, rounded half to even."""
    a = table(spark, sf, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", kernels.blend(F.col("embedding"), F.col("other"), 0.25, 100.0, 127.5).alias("mixed"))


# ------------------------------------------------------------------ verification

@query("""
SELECT 'orders_without_customer' AS "check", count(*) AS violations FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'lines_without_order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'orders_without_lines', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'customers_in_two_nations', count(*) FROM (SELECT c_custkey FROM customer GROUP BY c_custkey HAVING count(DISTINCT c_nationkey) > 1)
UNION ALL SELECT 'labels_without_document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def integrity_report(spark, sf):
    """Referential checks and leaks with their counts."""
    t = {n: table(spark, sf, n) for n in ("orders", "customer", "lineitem", "labels", "documents")}
    return verify.tally(
        {
            "orders_without_customer": verify.dangling(t["orders"], t["customer"], "o_custkey", "c_custkey"),
            "lines_without_order": verify.dangling(t["lineitem"], t["orders"], "l_orderkey", "o_orderkey"),
            "orders_without_lines": verify.dangling(t["orders"], t["lineitem"], "o_orderkey", "l_orderkey"),
            "customers_in_two_nations": verify.leaks(t["customer"], "c_custkey", "c_nationkey"),
            "labels_without_document": verify.dangling(t["labels"], t["documents"], "doc_id", "doc_id"),
        }
    )


@query("""
WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0)
SELECT k, 'extra' AS side FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'missing' FROM b WHERE k NOT IN (SELECT k FROM a)""")
def set_reconcile(spark, sf):
    """Two-way set difference."""
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    b = table(spark, sf, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"))
    return verify.difference(a, b, "k")


@query("""
WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT c_custkey AS k FROM customer)
SELECT count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS matched, count(*) FILTER (b.k IS NULL) AS left_only, count(*) FILTER (a.k IS NULL) AS right_only
FROM a FULL JOIN b ON a.k = b.k""")
def completeness(spark, sf):
    """Whether two key sets match exactly both ways."""
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    b = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    return verify.completeness(a, b, "k")


@query("""
SELECT o_orderpriority AS key, count(*) AS n, count(*) FILTER (o_totalprice > 100000) AS large FROM orders GROUP BY 1 ORDER BY CAST(left(o_orderpriority, 1) AS INTEGER)""")
def counts_by_number(spark, sf):
    """Counts by key in the order of the key's number, with a conditional count."""
    key = F.col("o_orderpriority")
    out = table(spark, sf, "orders").groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") > 100000).alias("large"))
    return out.orderBy(F.expr("try_cast(substring(key, 1, 1) AS int)"), "key")


@query("""
SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN ['priority'] ELSE [] END || CASE WHEN o_orderkey % 10 = 0 THEN ['status'] ELSE [] END AS changed FROM orders""")
def settings_diff(spark, sf):
    """Which settings differ, NULL equal to NULL."""
    o = table(spark, sf, "orders")
    a = {"priority": F.col("o_orderpriority"), "status": F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderstatus"))}
    b = {
        "priority": F.when(F.col("o_custkey") % 4 == 0, F.lit("x")).otherwise(F.col("o_orderpriority")),
        "status": F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderstatus")).when(F.col("o_orderkey") % 10 == 0, F.lit("y")),
    }
    return o.select("o_orderkey", verify.changed_settings(a, b).alias("changed"))


# ------------------------------------------------------------------ images

@query()
def surface_residual(spark, sf):
    """Deviation from a fitted quadratic surface by supplier."""
    l = table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_discount") * 10).alias("x"), (F.col("l_tax") * 10).alias("y"), (F.col("l_quantity") / 50).alias("v"))
    return _rounded(images.surface_residual(l, ["l_suppkey"], "x", "y", "v"), "residual")


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, (l_partkey % 256)::DOUBLE AS r, (l_orderkey % 256)::DOUBLE AS g, (l_suppkey * 7 % 256)::DOUBLE AS b FROM lineitem),
t AS (SELECT *, greatest(r, g, b) AS top, greatest(r, g, b) - least(r, g, b) AS span FROM p),
h AS (SELECT *, CASE WHEN span = 0 THEN 0 WHEN r = top THEN (g - b) / span WHEN g = top THEN 2 + (b - r) / span ELSE 4 + (r - g) / span END * 30 AS hue FROM t)
SELECT l_orderkey, l_linenumber, CAST(round_even(CASE WHEN hue < 0 THEN hue + 180 ELSE hue END, 0) AS INTEGER) % 180 AS h,
  CAST(round_even(CASE WHEN top = 0 THEN 0 ELSE span * 255 / top END, 0) AS INTEGER) AS s, CAST(top AS INTEGER) AS v FROM h""")
def hsv_pixels(spark, sf):
    """Hue, saturation and value of 8-bit pixel rows."""
    l = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_partkey") % 256).alias("r"), (F.col("l_orderkey") % 256).alias("g"), (F.col("l_suppkey") * 7 % 256).alias("b")
    )
    return l.select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in images.hsv(F.col("r"), F.col("g"), F.col("b")).items()])


@query("""
WITH v AS (SELECT vec_id, label, floor(128 + 100 * unnest(embedding)::DOUBLE) AS g, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings),
m AS (SELECT vec_id, label, avg(g) FILTER (p % 4 <> label % 4) AS light FROM v GROUP BY vec_id, label)
SELECT label, CASE WHEN vec_id % 3 > 0 AND vec_id % 24 NOT BETWEEN 7 AND 17 THEN 'night' WHEN vec_id % 11 = 0 THEN 'unreadable' WHEN light < 128 THEN 'dark' ELSE 'kept' END AS disposition,
  count(*) AS n, round(avg(light), 6) AS light FROM m GROUP BY ALL""")
def masked_brightness(spark, sf):
    """Drop reasons in order, brightness judged inside a mask only."""
    e = table(spark, sf, "embeddings").select(
        "vec_id", "label", F.transform("embedding", lambda x: F.floor(F.lit(128) + F.lit(100) * x.cast("double"))).alias("gray"),
        F.transform("embedding", lambda x, i: (i % 4 != F.col("label") % 4).cast("int")).alias("mask"),
    ).withColumn("light", images.masked_mean("gray", "mask"))
    split = F.when(F.col("vec_id") % 3 > 0, "train").otherwise("test")
    reason = dataset.disposition(split, (F.col("vec_id") % 24).cast("int"), F.col("vec_id") % 11 != 0, F.col("light"), 128.0)
    return e.groupBy("label", reason.alias("disposition")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("light"), 6).alias("light"))


@query("""
WITH p AS (SELECT l_suppkey, CAST(l_partkey % 180 AS INTEGER) AS h, CAST(l_orderkey % 256 AS INTEGER) AS s, CAST(l_quantity * 5 AS INTEGER) AS v FROM lineitem)
SELECT l_suppkey, round(avg((s >= 40 AND v >= 40 AND h BETWEEN 95 AND 130)::INT), 6) AS blue, round(avg((s >= 40 AND v >= 40 AND h BETWEEN 35 AND 85)::INT), 6) AS green,
  round(avg((s >= 40 AND v >= 40 AND h BETWEEN 5 AND 25)::INT), 6) AS warm, round(avg((s < 30 AND v >= 60)::INT), 6) AS neutral,
  round(avg((s < 30 AND v >= 200)::INT), 6) AS white, round(avg((v >= 250)::INT), 6) AS clipped, round(avg((v <= 10)::INT), 6) AS dark FROM p GROUP BY l_suppkey""")
def colour_shares(spark, sf):
    """Shares of colour classes over pixel rows."""
    p = table(spark, sf, "lineitem").select(
        "l_suppkey", (F.col("l_partkey") % 180).cast("int").alias("h"), (F.col("l_orderkey") % 256).cast("int").alias("s"), (F.col("l_quantity") * 5).cast("int").alias("v")
    )
    return p.groupBy("l_suppkey").agg(*[F.round(c, 6).alias(n) for n, c in images.colour_shares(F.col("h"), F.col("s"), F.col("v")).items()])


@query()
def tiled_fusion(spark, sf):
    """Exposures of small frames, four vectors an image, fused by overlapping tiles."""
    e = table(spark, sf, "embeddings")
    frames = e.select(
        F.floor(F.col("vec_id") / 4).alias("image"), (F.col("vec_id") % 4).cast("int").alias("k"), F.lit(8).alias("h"), F.lit(8).alias("w"),
        F.transform("embedding", lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(0.5) + x.cast("double")))).alias("pixels"),
    )
    return images.fused(frames, 6, 2)


@query()
def vanishing_points(spark, sf):
    """The point where most segments of a group meet."""
    l = table(spark, sf, "lineitem").select(
        "l_suppkey", F.col("l_quantity").alias("x1"), (F.col("l_discount") * 100).alias("y1"), (F.col("l_quantity") * 0.9 + 2).alias("x2"), (F.col("l_discount") * 100 + 20).alias("y2")
    )
    return kernels.vanishing_points(l, "l_suppkey").select("l_suppkey", "lines", "inliers")


@query("""
SELECT l_suppkey, count(*) FILTER (l_discount < 0.05) AS judged, round(median(abs(l_quantity / 10.0::DOUBLE - 2.5) / 2.5 * 100) FILTER (l_discount < 0.05), 6) AS median_error
FROM lineitem GROUP BY l_suppkey""")
def aspect_error(spark, sf):
    """Median percent error of an aspect ratio, items out of frame left out."""
    out = records.aspect_error(table(spark, sf, "lineitem"), ["l_suppkey"], F.col("l_quantity"), F.lit(10.0), F.lit(2.5), F.col("l_discount") < 0.05)
    return _rounded(out, "median_error")


@query("""
SELECT user_id, min('e' || event_id) || '-' || max('e' || event_id) || '.jpg' AS name, CAST(ceil(count(*) / 8.0) AS BIGINT) AS batches FROM events GROUP BY user_id""")
def output_names(spark, sf):
    """A name from each group's first and last file, and its number of batches."""
    e = table(spark, sf, "events").groupBy("user_id").agg(
        F.array(F.min(F.concat(F.lit("e"), "event_id")), F.max(F.concat(F.lit("e"), "event_id"))).alias("_ends"), F.count(F.lit(1)).alias("n")
    )
    return e.select("user_id", records.output_name(F.col("_ends"), "jpg").alias("name"), records.batches_needed(F.col("n"), 8).alias("batches"))


@query(EVIDENCE_SQL.replace("{ext}", "0.55").replace("SELECT doc_id, exterior, interior, call, round(", "SELECT doc_id::VARCHAR AS source, call, round(") )
def classification_log(spark, sf):
    """Rows of the classification log: call and confidence (outside rooms)."""
    rows = records.classification_rows(_features(spark, sf), "doc_id", "2024-01-01 00:00:00.000")
    made = scoring.classify(_features(spark, sf)).select(F.col("doc_id").cast("string").alias("source"), F.col("confidence").alias("sure"))
    return rows.join(made, "source").select("source", "call", F.round("sure", 6).alias("confidence"))


# ------------------------------------------------------------------ small rules on whole tables

@query("""
WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'no time' WHEN o_orderkey % 11 > 0 THEN strftime(o_orderdate, '%Y:%m:%d %H:%M:%S') END AS x FROM orders)
SELECT o_orderkey, strftime(try_strptime(x, '%Y:%m:%d %H:%M:%S'), '%Y%m%d%H%M%S') AS taken FROM t""")
def capture_times(spark, sf):
    """Capture times read from metadata text, NULL where it holds none."""
    written = F.when(F.col("o_orderkey") % 7 == 0, "no time").when(F.col("o_orderkey") % 11 > 0, F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss"))
    return table(spark, sf, "orders").select("o_orderkey", F.date_format(text.captured_at(written), "yyyyMMddHHmmss").alias("taken"))


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity * l_quantity / 400.0::DOUBLE AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, s < 1 AS fraction, round(CASE WHEN s < 1 THEN round_even(1 / s, 0) ELSE s END, 6) AS number,
  CAST(round_even((round_even((least(9.5::DOUBLE, greatest(0.5::DOUBLE, s)) - 0.5) / 0.25, 0) * 0.25 + 0.5) * 100, 0) AS INTEGER) AS slider FROM s""")
def exposure_labels(spark, sf):
    """Shutter times as 1/n or seconds, and a slider's value: clamped, then snapped."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * F.col("l_quantity") / 400.0).alias("s"))
    frac, number = text.shutter_parts(F.col("s"))
    return l.select("l_orderkey", "l_linenumber", frac.alias("fraction"), F.round(number, 6).alias("number"), numeric.clamp_snap(F.col("s"), 0.5, 9.5, 0.25).alias("slider"))


_WIDE = color.wide_to_standard()


@query("WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity / 50::DOUBLE AS r, l_discount * 10::DOUBLE AS g, l_tax * 12::DOUBLE AS b FROM lineitem) SELECT l_orderkey, l_linenumber, "
       + ", ".join(f"round({x!r}::DOUBLE * r + {y!r}::DOUBLE * g + {z!r}::DOUBLE * b, 5) AS {c}" for c, (x, y, z) in zip("rgb", _WIDE)) + " FROM p")
def wide_to_standard(spark, sf):
    """Linear colours from the wide space to the standard one."""
    l = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("r"), (F.col("l_discount") * 10).alias("g"), (F.col("l_tax") * 12).alias("b")
    )
    out = color.apply_matrix(_WIDE, (F.col("r"), F.col("g"), F.col("b")))
    return l.select("l_orderkey", "l_linenumber", *[F.round(x, 5).alias(c) for c, x in zip("rgb", out)])


@query("""
WITH p AS (SELECT c_nationkey, count(*) AS n, sum(CASE WHEN c_acctbal >= 0 THEN c_acctbal ELSE 0 END) / count(*) AS m FROM customer GROUP BY c_nationkey),
k AS (SELECT n_nationkey, n_nationkey % 5 AS covered, 4 AS pixels FROM nation)
SELECT c_nationkey, n, round(m, 6) AS c_acctbal FROM p WHERE n >= 5 AND c_nationkey IN (SELECT n_nationkey FROM k WHERE covered > 0 AND covered < pixels)""")
def usable_groups(spark, sf):
    """Profiles of enough rows whose mask is neither empty nor full."""
    profiles = dataset.profile(table(spark, sf, "customer"), "c_nationkey", ["c_acctbal"])
    masks = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_nationkey") % 5).alias("covered"), F.lit(4).alias("pixels"))
    return _rounded(dataset.usable(profiles, masks, "c_nationkey", 5), "c_acctbal")


@query("""
WITH d AS (SELECT doc_id, 'd' || doc_id || '.txt' AS name, coalesce(text, '') AS body FROM documents),
c AS (SELECT doc_id, name, md5(CASE WHEN doc_id % 9 = 0 THEN body || '!' ELSE body END) AS m FROM d),
h AS (SELECT name, md5(body) AS m FROM d WHERE doc_id % 4 > 0)
SELECT doc_id, name FROM c WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.name = c.name AND h.m = c.m)""")
def checksum_gate(spark, sf):
    """Catalog rows that no local file of the same name and checksum confirms."""
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("d"), "doc_id", F.lit(".txt")).alias("name"), F.coalesce("text", F.lit("")).alias("body"))
    stored = F.when(F.col("doc_id") % 9 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body"))
    catalog = d.select("doc_id", "name", F.md5(stored.cast("binary")).alias("md5"))
    local = d.filter("doc_id % 4 > 0").select("name", F.col("body").cast("binary").alias("content"))
    return files.worklist(catalog, local).select("doc_id", "name")


@query("""
WITH n AS (SELECT o_orderkey AS job_id, unnest(['f' || o_custkey, 'f' || (o_custkey + 1)]) AS path FROM orders)
SELECT job_id, path FROM n WHERE path NOT IN (SELECT 'f' || c_custkey FROM customer WHERE c_custkey % 3 > 0)""")
def missing_inputs(spark, sf):
    """Files that jobs name and the listing lacks."""
    file = lambda c: F.concat(F.lit("f"), c.cast("string"))
    jobs = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.to_json(F.array(file(F.col("o_custkey")), file(F.col("o_custkey") + 1))).alias("bracket_files")
    )
    listing = table(spark, sf, "customer").filter("c_custkey % 3 > 0").select(file(F.col("c_custkey")).alias("path"))
    return ledger.missing_files(jobs, "bracket_files", listing, "path").select("job_id", "path")


@query("""
WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS e FROM embeddings),
c AS (SELECT vec_id, count(*) FILTER (e > 0 AND e > 0.1::DOUBLE) AS ip, count(*) FILTER (e > 0 OR e > 0.1::DOUBLE) AS up,
  count(*) FILTER (NOT e > 0 AND NOT e > 0.1::DOUBLE) AS n, count(*) FILTER (NOT e > 0 OR NOT e > 0.1::DOUBLE) AS un FROM v GROUP BY vec_id)
SELECT vec_id, round(ip / nullif(up, 0)::DOUBLE, 6) AS pos_iou, round(n / nullif(un, 0)::DOUBLE, 6) AS neg_iou,
  round((ip / nullif(up, 0)::DOUBLE + n / nullif(un, 0)::DOUBLE) / 2, 6) AS miou FROM c""")
def image_rates(spark, sf):
    """Rates of each image from its pixels."""
    pixels = table(spark, sf, "embeddings").select("vec_id", F.explode("embedding").alias("e"))
    per = pixels.groupBy("vec_id").agg(*metrics.counts(F.col("e") > 0, F.col("e").cast("double") > 0.1))
    return _rounded(metrics.rates(per).select("vec_id", "pos_iou", "neg_iou", "miou"), "pos_iou", "neg_iou", "miou")
