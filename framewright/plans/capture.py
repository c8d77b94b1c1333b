"""Queries on sessions, ledger, learning and normalising, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import numeric, text
from framewright.operators import learn, ledger, normalize, sessions
from framewright.plans.base import query, table

LONG, SHORT = 52_000.0, 11_000.0


def _sessions(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "ts", "user_id", "value")
    return sessions.assign_sessions(events, ["user_id"], "ts", "event_id", "value", 3, LONG, SHORT)


SESSIONS_SQL = f"""
WITH RECURSIVE g AS (
  SELECT user_id, event_id, ts, row_number() OVER w AS rn,
         (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / CAST(1e6 AS DOUBLE) - lag(value) OVER w AS gap
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (
  SELECT user_id, event_id, ts, rn, CAST(0 AS BIGINT) AS session, CAST(1 AS BIGINT) AS size FROM g WHERE rn = 1
  UNION ALL
  SELECT g.user_id, g.event_id, g.ts, g.rn,
         CASE WHEN g.gap <= {LONG} AND NOT (s.size >= 3 AND g.gap > {SHORT}) THEN s.session ELSE s.session + 1 END,
         CASE WHEN g.gap <= {LONG} AND NOT (s.size >= 3 AND g.gap > {SHORT}) THEN s.size + 1 ELSE 1 END
  FROM s JOIN g ON g.user_id = s.user_id AND g.rn = s.rn + 1)
"""


@query(SESSIONS_SQL + """
SELECT user_id, session, count(*) AS n, min_by(event_id, rn) AS first_event, max_by(event_id, rn) AS last_event
FROM s GROUP BY user_id, session HAVING count(*) >= 3""")
def session_brackets(spark, sf):
    """Records of each user in size-dependent sessions of three or more."""
    kept, _ = sessions.brackets(_sessions(spark, sf), ["user_id"], "ts", "event_id")
    return kept.select(
        "user_id", "session", "n", F.element_at("members", 1).alias("first_event"), F.element_at("members", -1).alias("last_event")
    )


@query(SESSIONS_SQL + """
, r AS (SELECT user_id, session, count(*) AS n FROM s GROUP BY user_id, session HAVING count(*) < 3)
SELECT s.user_id, s.session, s.event_id, r.n FROM s JOIN r USING (user_id, session)""")
def session_rejects(spark, sf):
    """Records whose session is too small, none dropped in silence."""
    _, rejects = sessions.brackets(_sessions(spark, sf), ["user_id"], "ts", "event_id")
    return rejects.select("user_id", "session", F.explode("members").alias("event_id"), "n")


@query("""
WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 100 = 0 THEN NULL ELSE ts END AS ts FROM events),
m AS (SELECT *, bool_or(ts IS NULL) OVER (PARTITION BY user_id) AS missing,
             row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM e)
SELECT user_id, event_id, CAST(i // 3 AS BIGINT) AS chunk, count(*) OVER (PARTITION BY user_id, i // 3) = 3 AS complete
FROM m WHERE missing""")
def chunk_fallback(spark, sf):
    """Users with a missing time: records by name, three at a time, leftovers marked."""
    events = table(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_id") % 100 != 0, F.col("ts")).alias("ts"))
    return sessions.chunks_by_name(events, ["user_id"], "ts", "event_id").select("user_id", "event_id", "chunk", "complete")


_LACKING = "(SELECT user_id FROM events WHERE user_id % 3 = 0 AND event_id % 100 = 0)"


@query(SESSIONS_SQL.replace("FROM events WINDOW", f"FROM (SELECT * FROM events WHERE user_id NOT IN {_LACKING}) WINDOW") + f"""
, m AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events WHERE user_id IN {_LACKING})
SELECT user_id, event_id, session AS "group", 'time' AS way, count(*) OVER (PARTITION BY user_id, session) >= 3 AS complete FROM s
UNION ALL SELECT user_id, event_id, CAST(i // 3 AS BIGINT), 'name', count(*) OVER (PARTITION BY user_id, i // 3) = 3 FROM m""")
def grouped_inputs(spark, sf):
    """Each user's records by time, or all of them by name where one time is missing."""
    missing = (F.col("user_id") % 3 == 0) & (F.col("event_id") % 100 == 0)
    events = table(spark, sf, "events").select("user_id", "event_id", F.when(~missing, F.col("ts")).alias("ts"), "value")
    out = sessions.grouped(events, ["user_id"], "ts", "event_id", "value", 3, LONG, SHORT)
    return out.select("user_id", "event_id", "group", "way", "complete")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def sidecar_anti(spark, sf):
    """Rows without a partner of the same key: the form of sidecar suppression."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return orders.join(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("""
SELECT user_id, event_type, event_id FROM (
  SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS i,
         count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events) WHERE i = n // 2""")
def midpoint_example(spark, sf):
    """The chronological middle record of each pair of keys."""
    events = table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts")
    return sessions.middle(events, ["user_id", "event_type"], "ts", "event_id").drop("ts")


@query("""
WITH v AS (SELECT DISTINCT user_id, floor(value * 10) / 10 AS v FROM events),
d AS (SELECT user_id, v, CASE WHEN v - lag(v) OVER (PARTITION BY user_id ORDER BY v) > 5 THEN 1 ELSE 0 END AS e FROM v),
r AS (SELECT user_id, v, CAST(sum(e) OVER (PARTITION BY user_id ORDER BY v) AS BIGINT) AS run FROM d)
SELECT user_id, run, min(v) AS low, max(v) AS high, count(*) AS n FROM r GROUP BY user_id, run HAVING min(v) <= 60 AND max(v) >= 20""")
def islands(spark, sf):
    """Runs of values with gaps up to 5 that share a point with [20, 60]."""
    values = table(spark, sf, "events").select("user_id", (F.floor(F.col("value") * 10) / 10).alias("v")).distinct()
    return sessions.overlapping(sessions.islands(values, ["user_id"], "v", 5.0), F.lit(20.0), F.lit(60.0))


@query("""
WITH x AS (SELECT event_id, user_id, value AS shutter, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 1.0 + event_id % 5 END::DOUBLE AS f,
                  (100 * (1 + event_id % 3))::DOUBLE AS iso FROM events),
b AS (SELECT *, round(shutter * iso / (f * f), 6) AS exposure, bool_and(f IS NOT NULL) OVER (PARTITION BY user_id) AS all_known FROM x)
SELECT user_id, event_id, exposure, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN all_known THEN exposure END, event_id) AS place FROM b""")
def exposure_order(spark, sf):
    """Relative exposure, and the order by it where every row of the group has one."""
    from pyspark.sql import Window

    e = table(spark, sf, "events").select(
        "event_id", "user_id", F.col("value").alias("shutter"),
        F.when(F.col("event_id") % 7 != 0, 1.0 + F.col("event_id") % 5).cast("double").alias("f"),
        (100 * (1 + F.col("event_id") % 3)).cast("double").alias("iso"),
    )
    e = e.withColumn("exposure", F.round(numeric.relative_exposure(F.col("shutter"), F.col("f"), F.col("iso")), 6))
    w = Window.partitionBy("user_id")
    e = e.withColumn("_all", F.bool_and(F.col("f").isNotNull()).over(w))
    order = w.orderBy(F.when(F.col("_all"), F.col("exposure")).asc_nulls_last(), "event_id")
    return e.select("user_id", "event_id", "exposure", F.row_number().over(order).cast("long").alias("place"))


@query("""
SELECT user_id, count(*) AS n, bool_and(v < 90) AS all_small, bool_or(v > 90) AS any_large,
       CAST(count(DISTINCT k) + max(CASE WHEN k IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS kinds
FROM (SELECT user_id, value AS v, CASE WHEN event_id % 3 > 0 THEN event_id % 3 END AS k FROM events) GROUP BY user_id""")
def uniformity(spark, sf):
    """all, any, and the number of distinct values with NULL as one."""
    e = table(spark, sf, "events").withColumn("k", F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 3))
    return e.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.col("value") < 90).alias("all_small"), F.bool_or(F.col("value") > 90).alias("any_large"),
        numeric.distinct_with_null(F.col("k")).cast("long").alias("kinds"),
    )


@query("""
WITH r AS (SELECT event_type, user_id % 5 AS p, value - 50 AS d, row_number() OVER (PARTITION BY event_type, user_id % 5 ORDER BY event_id DESC) AS r FROM events),
k AS (SELECT *, count(*) OVER (PARTITION BY event_type, p) AS n FROM r WHERE r <= 200),
w AS (SELECT event_type, p, n, d, n - r + 1 AS k,
       CASE WHEN n <= 5 THEN CAST(1 AS DOUBLE) / n WHEN n - r + 1 <= 5 THEN pow(CAST(0.8 AS DOUBLE), n - 5) / 5 ELSE CAST(0.2 AS DOUBLE) * pow(CAST(0.8 AS DOUBLE), r - 1) END AS w FROM k),
a AS (SELECT event_type, p, count(*) AS n, sum(w * d) AS shift FROM w GROUP BY event_type, p),
t AS (SELECT DISTINCT event_type FROM events), q AS (SELECT unnest(range(7)) AS p)
SELECT t.event_type, q.p AS param, coalesce(a.n, 0) AS n, round(CAST(1.5 AS DOUBLE) + CASE WHEN a.n >= 5 THEN a.shift ELSE 0 END, 6) AS value
FROM t CROSS JOIN q LEFT JOIN a ON a.event_type = t.event_type AND a.p = q.p""")
def ema_defaults(spark, sf):
    """Learned defaults by (scene, parameter) over the latest 200 adjustments."""
    events = table(spark, sf, "events").select(
        "event_type", (F.col("user_id") % 5).alias("param"), "event_id", F.lit(50.0).alias("auto_value"), F.col("value").alias("user_value")
    )
    averages = learn.average(learn.adjustment(events), ["event_type", "param"], "event_id", "delta")
    defaults = events.select("event_type").distinct().crossJoin(
        F.broadcast(spark.range(7).select(F.col("id").alias("param"), F.lit(1.5).alias("value")))
    )
    return learn.learned(defaults, averages, ["event_type", "param"]).withColumn("value", F.round("value", 6))


@query("""
SELECT event_type, count(*) FILTER (event_type IS DISTINCT FROM 'click') AS kept,
       count(*) FILTER (event_type = 'click') AS removed FROM events GROUP BY event_type""")
def forget_adjustments(spark, sf):
    """Removal by key with its count."""
    kept, gone = learn.forget(table(spark, sf, "events"), "event_type", "click")
    kept = kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("kept"))
    types = table(spark, sf, "events").select("event_type").distinct()
    return types.join(kept, "event_type", "left").crossJoin(F.broadcast(gone)).select(
        "event_type", F.coalesce("kept", F.lit(0)).alias("kept"), F.when(F.col("event_type") == "click", F.col("removed")).otherwise(0).alias("removed")
    )


PART = """
WITH p AS (SELECT p_partkey, p_brand AS g, CASE WHEN p_partkey % 17 > 0 THEN 30 + p_size END::DOUBLE AS l,
  CASE WHEN p_partkey % 13 > 0 THEN p_partkey % 21 - 10 END::DOUBLE AS a, CASE WHEN p_partkey % 13 > 0 THEN p_partkey % 11 - 5 END::DOUBLE AS b FROM part)
"""


@query(PART + """
, t AS (SELECT g, count(*) AS c, median(l) AS tl, median(a) AS ta, median(b) AS tb FROM p GROUP BY g),
j AS (SELECT p.*, CASE WHEN c >= 3 THEN tl END AS tl, CASE WHEN c >= 3 THEN ta END - a AS da, CASE WHEN c >= 3 THEN tb END - b AS db FROM p JOIN t USING (g)),
k AS (SELECT *, tl - l AS nl, sqrt(da * da + db * db) AS nab FROM j),
o AS (SELECT *, abs(nl) > 12 AS ol, coalesce(nab > 8, false) AS oab FROM k),
z AS (SELECT *, nl IS NOT NULL AND NOT ol AND NOT oab AS ok FROM o)
SELECT p_partkey, CASE WHEN ok THEN 'corrected' ELSE 'skipped' END AS status,
  CASE WHEN tl IS NULL THEN 'no_target' WHEN l IS NULL THEN 'unmeasured' WHEN NOT ok THEN concat_ws('+', CASE WHEN ol THEN 'dl' END, CASE WHEN oab THEN 'dab' END)
       WHEN nab IS NULL THEN 'brightness_only' ELSE '' END AS reason,
  round(nl, 6) AS needed_dl, round(CASE WHEN nl IS NOT NULL THEN nab END, 6) AS needed_dab,
  round(CASE WHEN ok THEN 0.7::DOUBLE * nl END, 6) AS applied_dl, round(CASE WHEN ok AND nab IS NOT NULL THEN 0.7::DOUBLE * da END, 6) AS applied_da,
  round(CASE WHEN ok AND nab IS NOT NULL THEN 0.7::DOUBLE * db END, 6) AS applied_db FROM z""")
def group_target_sync(spark, sf):
    """Shifts toward group medians under the caps, with status and reason codes."""
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select(
        "p_partkey", F.col("p_brand").alias("g"), F.when(k % 17 > 0, 30.0 + F.col("p_size")).alias("l"),
        F.when(k % 13 > 0, (k % 21 - 10).cast("double")).alias("a"), F.when(k % 13 > 0, (k % 11 - 5).cast("double")).alias("b"),
    )
    out = normalize.sync(p, "g")
    nums = ("needed_dl", "needed_dab", "applied_dl", "applied_da", "applied_db")
    return out.select("p_partkey", "status", "reason", *[F.round(c, 6).alias(c) for c in nums])


def _round(i: int) -> str:
    return f"""
, f{i} AS (SELECT g, avg(x) FILTER (d <= 2.53) AS na, avg(y) FILTER (d <= 2.53) AS nb, avg(CASE WHEN d <= 2.53 THEN 1.0 ELSE 0.0 END) AS ns
  FROM (SELECT r.g, x, y, sqrt((x - a) * (x - a) + (y - b) * (y - b)) AS d FROM r JOIN c{i} USING (g)) GROUP BY g),
c{i + 1} AS (SELECT g, CASE WHEN done OR ns = 0 THEN a ELSE na END AS a, CASE WHEN done OR ns = 0 THEN b ELSE nb END AS b,
  CASE WHEN done THEN share ELSE ns END AS share, done OR ns = 0 AS done FROM c{i} JOIN f{i} USING (g))"""


@query("""
WITH r AS (SELECT l_suppkey AS g, l_discount * 100 AS x, l_tax * 100 AS y FROM lineitem),
c0 AS (SELECT g, median(x) AS a, median(y) AS b, CAST(1 AS DOUBLE) AS share, false AS done FROM r GROUP BY g)"""
+ _round(0) + _round(1) + _round(2) + "\nSELECT g AS l_suppkey, round(a, 6) AS a, round(b, 6) AS b, round(share, 6) AS share FROM c3")
def trimmed_centre(spark, sf):
    """Three rounds of the mean within a radius of the last centre, from the median."""
    l = table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_discount") * 100).alias("x"), (F.col("l_tax") * 100).alias("y"))
    out = normalize.trimmed_centre(l, "l_suppkey", "x", "y", 2.53)
    return out.select("l_suppkey", *[F.round(c, 6).alias(c) for c in ("a", "b", "share")])


@query("""
WITH p AS (SELECT l_suppkey AS g, l_quantity * 2 AS l, l_discount * 100 AS x, l_tax * 100 AS y FROM lineitem),
m AS (SELECT g, avg(CASE WHEN l BETWEEN 3 AND 97 THEN 1.0 ELSE 0.0 END) AS valid_share, median(l) FILTER (l BETWEEN 3 AND 97) AS l FROM p GROUP BY g),
r AS (SELECT g, x, y FROM p WHERE l BETWEEN 3 AND 97),
c0 AS (SELECT g, median(x) AS a, median(y) AS b, CAST(1 AS DOUBLE) AS share, false AS done FROM r GROUP BY g)"""
+ _round(0) + _round(1) + _round(2) + """
SELECT m.g AS l_suppkey, round(CASE WHEN valid_share >= 0.94 THEN l END, 6) AS l, round(CASE WHEN valid_share >= 0.94 AND share >= 0.3 THEN a END, 6) AS a,
  round(CASE WHEN valid_share >= 0.94 AND share >= 0.3 THEN b END, 6) AS b, round(valid_share, 6) AS valid_share,
  round(CASE WHEN valid_share >= 0.94 THEN share ELSE 0 END, 6) AS neutral_share FROM m LEFT JOIN c3 ON c3.g = m.g""")
def image_measure(spark, sf):
    """Lightness and colour cast of images from their pixels, with the least shares."""
    l = table(spark, sf, "lineitem").select(
        "l_suppkey", (F.col("l_quantity") * 2).alias("l"), (F.col("l_discount") * 100).alias("a"), (F.col("l_tax") * 100).alias("b")
    )
    out = normalize.measure(l, "l_suppkey", 0.94, 0.3, 2.53)
    return out.select("l_suppkey", *[F.round(c, 6).alias(c) for c in ("l", "a", "b", "valid_share", "neutral_share")])


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity * 2 AS l, l_discount * 100 AS a, l_tax * 100 AS b, 30 + l_suppkey % 40 AS old, 32 + l_suppkey % 31 AS new,
  CASE WHEN l_suppkey % 5 > 0 THEN (l_suppkey % 7) - 3.0::DOUBLE END AS d FROM lineitem),
g AS (SELECT *, ln(new / 100.0::DOUBLE) / ln(old / 100.0::DOUBLE) AS gamma FROM p),
m AS (SELECT *, CASE WHEN abs(gamma - 1) <= 1e-6 THEN l ELSE 100 * pow(least(100, greatest(0, l)) / 100, gamma) END AS moved FROM g),
w AS (SELECT *, greatest(0, least(1, least(moved, 100 - moved) / 10)) AS fade FROM m)
SELECT l_orderkey, l_linenumber, round(moved, 6) AS l, round(a + coalesce(d, 0) * fade, 6) AS a, round(b - coalesce(d, 0) * fade, 6) AS b FROM w""")
def gallery_apply(spark, sf):
    """Pixels after the correction of their image."""
    supplier = F.col("l_suppkey")
    shift = F.when(supplier % 5 > 0, (supplier % 7) - F.lit(3.0))
    pixels = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_quantity") * 2).alias("l"), (F.col("l_discount") * 100).alias("a"), (F.col("l_tax") * 100).alias("b")
    )
    out = normalize.corrected(pixels, (F.lit(30) + supplier % 40).cast("double"), (F.lit(32) + supplier % 31).cast("double"), shift, -shift)
    return out.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in ("l", "a", "b")])


@query("""
SELECT s.status, count(o.o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) s(status)
LEFT JOIN orders o ON o.o_orderstatus = s.status GROUP BY s.status""")
def status_rollup(spark, sf):
    """Jobs by state, every state present."""
    return ledger.rollup(table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status")), statuses=("F", "O", "P", "X"))


def _log(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    step = lambda i, old, new, keep: o.filter(keep).select(
        (F.col("o_orderkey") * 3 + i).alias("run_id"), F.col("o_orderkey").alias("job_id"), F.lit(old).cast("string").alias("old_status"),
        F.lit(new).alias("new_status"), F.lit(f"2024-01-01 00:00:0{i}.000").alias("timestamp"),
    )

    return (
        step(0, None, "pending", F.lit(True))
        .unionByName(step(1, "pending", "running", F.col("o_orderstatus") != "O"))
        .unionByName(step(2, "running", "x", F.col("o_orderstatus") == "F").withColumn("new_status", F.when(F.col("job_id") % 4 == 0, "failed").otherwise("complete")))
    )


LOG_STATES = """
WITH st AS (SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus = 'O' THEN 'pending' WHEN o_orderstatus = 'F' AND o_orderkey % 4 = 0 THEN 'failed'
  WHEN o_orderstatus = 'F' THEN 'complete' ELSE 'running' END AS status, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 3 ELSE 2 END AS n FROM orders)
"""


@query(LOG_STATES + """
SELECT job_id, CASE WHEN status = 'running' THEN 'pending' WHEN status = 'failed' THEN 'pending' ELSE status END AS status,
  CAST(n + CASE WHEN status IN ('running', 'failed') THEN 1 ELSE 0 END AS BIGINT) AS n_runs FROM st""")
def transition_log(spark, sf):
    """States after crash recovery and retry, from the transition log alone."""
    log = _log(spark, sf)
    at = F.lit("2024-01-02 00:00:00.000")
    top = F.col("job_id") * 3 + 1_000_000_000_000
    more = ledger.recover(log, at).unionByName(ledger.retry(log, at)).withColumn("run_id", top)
    return ledger.current(log.unionByName(more.select(*log.columns)))


@query(LOG_STATES + "SELECT min(job_id) AS job_id, any_value(status) AS status FROM (SELECT * FROM st WHERE status = 'pending' ORDER BY job_id LIMIT 1)")
def queue_head(spark, sf):
    """The oldest pending job."""
    return ledger.queue_head(ledger.current(_log(spark, sf))).select("job_id", "status")


@query("""
SELECT count(*) FILTER (o_orderkey % 3 <> 0) AS added, count(*) FILTER (o_orderkey % 3 = 0) AS skipped FROM orders""")
def enqueue_dedupe(spark, sf):
    """How many candidates are new, and how many known."""
    orders = table(spark, sf, "orders").select("o_orderkey")
    return ledger.enqueue_report(orders, orders.filter("o_orderkey % 3 = 0"), "o_orderkey")


@query("""
SELECT o_orderkey AS job_id, o_orderstatus AS status, o_orderkey % 3 > 0 AS timed, o_orderkey % 5 > 0 AS measured,
  CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS wall_seconds, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS peak_memory_mb FROM orders""")
def job_history(spark, sf):
    """Both measures may be missing, each on its own."""
    k = F.col("o_orderkey")
    jobs = table(spark, sf, "orders").select(
        k.alias("job_id"), F.col("o_orderstatus").alias("status"), F.when(k % 3 > 0, F.col("o_totalprice")).alias("wall_seconds"),
        F.when(k % 5 > 0, F.col("o_totalprice")).alias("peak_memory_mb"),
    )
    return ledger.history(jobs)


@query("""
SELECT l_orderkey, max(v) FILTER (m = 'whole') AS whole, max(v) FILTER (m = 'tiled') AS tiled,
  round(max(v) FILTER (m = 'tiled') - max(v) FILTER (m = 'whole'), 6) AS change
FROM (SELECT l_orderkey, CASE WHEN l_linenumber % 2 = 1 THEN 'whole' ELSE 'tiled' END AS m, l_extendedprice AS v FROM lineitem) GROUP BY l_orderkey""")
def mode_comparison(spark, sf):
    """Whole and tiled runs of one key side by side."""
    l = table(spark, sf, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") % 2 == 1, "whole").otherwise("tiled").alias("m"), "l_extendedprice")
    return ledger.compare_modes(l, "l_orderkey", "l_extendedprice", "m", "whole", "tiled").withColumn("change", F.round("change", 6))


@query("""
SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 7) AS k, coalesce(CAST(json_extract_string(props, '$.tile_size') AS BIGINT), 0) AS tile_size,
  coalesce(CAST(json_extract_string(props, '$.overlap') AS BIGINT), 256) AS overlap FROM events""")
def json_defaults(spark, sf):
    """Settings from JSON with defaults for missing keys."""
    return table(spark, sf, "events").select(
        "event_id", *[text.setting(F.col("props"), k, d, "long").alias(k) for k, d in (("k", 7), ("tile_size", 0), ("overlap", 256))]
    )


@query("""
SELECT s_suppkey, gain, round(s_acctbal * gain, 6) AS exposed FROM supplier CROSS JOIN (VALUES (CAST(0.25 AS DOUBLE)), (1.0), (4.0)) g(gain)""")
def synthetic_brackets(spark, sf):
    """Three exposures of every row."""
    gains = F.broadcast(spark.createDataFrame([(0.25,), (1.0,), (4.0,)], "gain double"))
    return table(spark, sf, "supplier").crossJoin(gains).select("s_suppkey", "gain", F.round(F.col("s_acctbal") * F.col("gain"), 6).alias("exposed"))
