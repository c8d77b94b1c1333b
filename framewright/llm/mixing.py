"""Operator 4, mixing sources to target weights by min-cost flow.

Documents may belong to several sources. They are aggregated by membership pattern (the set of
their sources); a flow network routes each pattern's words to the quotas of its sources. A
pattern offers its words once at cost 0, a second time at cost 1, and so on: the costs are
convex, so nothing is repeated while unused words can fill a quota. The flow says how many words
each pattern gives; within a pattern, documents are then taken in seeded order.

Quotas: sources in code-point order, null last, get repeating weights; they share
``share`` times all words by weight. A quota stops at ``repeats`` times its source's words and
the excess is shared again by weight until none is above.

What meets on the driver is one row per pattern, whatever their number: its memory is the limit.
Every document counts for all of its sources, and every pattern, one of a single source too, is
part of the network. Up to ``max_patterns`` patterns are routed edge by edge (``Flow``), more on
arrays with the same optimum (``route_arrays``); tables of more than
``max_sources`` patterns are not broadcast. The seeded order is that of
an md5 of seed and doc_id. The place where a pattern's remainder ends is found by three rounds of
sums over 256 hash ranges, each inside the range that the round before has found, so no task ever
orders a whole source.

Null texts and empty texts have no words and nothing is taken of them. Repeated rows are
documents of their own. An empty table gives an empty result. Extra columns are ignored. The
last document taken may be taken in part, so a source's words meet its quota to the word.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.common import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
DIGITS, ROUNDS = 2, 3
MOST_EDGES = 256  # patterns that are routed edge by edge


def fill(sizes: dict, weights: dict, share: float, repeats: int) -> dict:
    """Target of each source. Sources meet their stop in the order of stop over weight."""
    total, wsum, capped = share * sum(sizes.values()), sum(weights.values()), 0
    out = {}
    order = sorted(sizes, key=lambda s: (repeats * sizes[s] / weights[s], s is None, s or ""))
    level = None
    for s in order:
        if level is None:
            at = (total - capped) / wsum
            if at > repeats * sizes[s] / weights[s]:
                out[s] = float(repeats * sizes[s])
                capped += repeats * sizes[s]
                wsum -= weights[s]
                continue
            level = at
        out[s] = level * weights[s]
    return out


class Flow:
    """Min-cost flow by successive shortest paths with node potentials."""

    def __init__(self) -> None:
        self.edges: list[list] = []
        self.at: dict = defaultdict(list)

    def edge(self, a, b, room: int, cost: int) -> int:
        self.at[a].append(len(self.edges))
        self.edges.append([b, room, cost])
        self.at[b].append(len(self.edges))
        self.edges.append([a, 0, -cost])
        return len(self.edges) - 2

    def run(self, start, end) -> None:
        height: dict = defaultdict(int)
        while True:
            best, via, heap, n = {start: 0}, {}, [(0, 0, start)], 0
            while heap:
                d, _, node = heapq.heappop(heap)
                if d > best[node]:
                    continue
                for i in self.at[node]:
                    to, room, cost = self.edges[i]
                    step = d + cost + height[node] - height[to]
                    if room > 0 and step < best.get(to, step + 1):
                        best[to], via[to] = step, i
                        n += 1
                        heapq.heappush(heap, (step, n, to))
            if end not in best:
                return
            far = max(best.values())
            for node in list(self.at):
                height[node] += best.get(node, far)
            room, node = None, end
            while node != start:
                i = via[node]
                room = self.edges[i][1] if room is None else min(room, self.edges[i][1])
                node = self.edges[i ^ 1][0]
            node = end
            while node != start:
                i = via[node]
                self.edges[i][1] -= room
                self.edges[i ^ 1][1] += room
                node = self.edges[i ^ 1][0]


def route_arrays(patterns: dict, quotas: dict, repeats: int) -> dict:
    """The optimum of ``Flow`` for many patterns. An augmenting path costs what its first edge costs,
    so the min-cost flow is a maximum flow for each repetition in turn. A path goes from patterns
    with spare words through sources, each handing on words of patterns that the next one shares,
    to a source with room; shortest paths first, all patterns of a step at once."""
    sets = sorted(patterns, key=repr)
    names = sorted({s for m in sets for s in m}, key=repr)
    number = {s: i for i, s in enumerate(names)}
    words = np.array([patterns[m] for m in sets], np.int64)
    room = np.array([quotas[s] for s in names], np.int64)
    p = np.repeat(np.arange(len(sets)), [len(m) for m in sets])
    s = np.array([number[x] for m in sets for x in m], np.int64)
    by = np.argsort(s, kind="stable")
    p, s = p[by], s[by]
    at = np.searchsorted(s, np.arange(len(names) + 1))
    flow, spare = np.zeros(len(p), np.int64), np.zeros(len(sets), np.int64)
    taken = lambda x, most: np.clip(most - (np.cumsum(x) - x), 0, x)

    def path() -> list[int]:
        """Sources from one that patterns with spare words have to one with room, or none."""
        far, step = np.where(room > 0, 0, -1), 0
        while True:
            here = np.flatnonzero(far[s] == step)
            if not len(here):
                return []
            ready = here[spare[p[here]] > 0]
            if len(ready):
                break
            near = np.zeros(len(sets), bool)
            near[p[here]] = True
            far[s[near[p] & (flow > 0) & (far[s] < 0)]] = step + 1
            step += 1
        out = [int(np.bincount(s[ready], weights=spare[p[ready]]).argmax())]
        for k in range(step - 1, -1, -1):
            held, mine = np.zeros(len(sets)), slice(at[out[-1]], at[out[-1] + 1])
            held[p[mine]] = flow[mine]
            out.append(int(np.bincount(s, weights=held[p] * (far[s] == k)).argmax()))
        return out

    # Patterns of one source have a path of their own: all of these carry at once.
    alone = np.flatnonzero(np.bincount(p, minlength=len(sets))[p] == 1)
    for _ in range(repeats):
        spare += words
        most = np.minimum(spare[p[alone]], room[s[alone]])
        flow[alone] += most
        spare[p[alone]] -= most
        room[s[alone]] -= most
        while way := path():
            first = slice(at[way[0]], at[way[0] + 1])
            moves = []
            for a, b in zip(way, way[1:]):
                _, i, j = np.intersect1d(p[at[a] : at[a + 1]], p[at[b] : at[b + 1]], assume_unique=True, return_indices=True)
                moves.append((at[a] + i, at[b] + j, flow[at[a] + i]))
            most = min(room[way[-1]], spare[p[first]].sum(), *(x.sum() for *_, x in moves))
            for i, j, x in moves:
                x = taken(x, most)
                flow[i] -= x
                flow[j] += x
            x = taken(spare[p[first]], most)
            flow[first] += x
            spare[p[first]] -= x
            room[way[-1]] -= most
    return dict(zip(sets, (words * repeats - spare).tolist()))


def network(patterns: dict, quotas: dict, repeats: int) -> tuple[Flow, dict]:
    """The network, and for each pattern its edges (number, words) by repetition."""
    flow, gives = Flow(), defaultdict(list)
    for k, (members, words) in enumerate(sorted(patterns.items(), key=lambda x: repr(x[0]))):
        for copy in range(repeats):
            gives[members].append((flow.edge("start", ("p", k), words, copy), words))
        for s in members:
            flow.edge(("p", k), ("s", s), repeats * words, 0)
    for s in sorted({s for m in patterns for s in m}, key=repr):
        flow.edge(("s", s), "end", quotas[s], 0)
    return flow, gives


def route(patterns: dict, quotas: dict, repeats: int, max_patterns: int = MOST_EDGES) -> dict:
    """Words that each pattern gives. patterns: tuple of sources -> words; quotas: source -> words."""
    if len(patterns) > max_patterns:
        return route_arrays(patterns, quotas, repeats)
    flow, gives = network(patterns, quotas, repeats)
    flow.run("start", "end")
    return {m: sum(words - flow.edges[i][1] for i, words in each) for m, each in gives.items()}


def mix(
    docs: DataFrame,
    members: str | None = None,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    repeats: int = 2,
    seed: int = 0,
    max_patterns: int = MOST_EDGES,
    max_sources: int = 100_000,
) -> DataFrame:
    """doc_id, size, source_size, target, taken. ``members`` names an array column with a
    document's sources; without it, the column source is its only one. source_size and target
    are those of the document's first source."""
    spark = docs.sparkSession
    own = F.array_distinct(F.col(members)) if members else F.array(F.col("source"))
    sized = materialize(
        docs.select(
            "doc_id",
            F.array_sort(own).alias("members"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")).cast("binary")).alias("h"),
        ),
        "mixing",
    )
    total = sized.groupBy("members").agg(F.sum("size").alias("words"))
    found = {tuple(r["members"] or ()): int(r["words"] or 0) for r in total.collect()}
    sizes: dict = defaultdict(int)
    for m, words in found.items():
        for s in m:
            sizes[s] += words
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-8", "surrogatepass")))
    targets = fill(dict(sizes), {s: weights[i % len(weights)] for i, s in enumerate(order)}, share, repeats) if sizes else {}
    quotas = {s: min(int(t + 0.5), repeats * sizes[s]) for s, t in targets.items()}
    given = route(found, quotas, repeats, max_patterns)
    small = F.broadcast if len(found) <= max_sources else (lambda df: df)
    plan = [
        (list(m), sizes[m[0]] if m else 0, targets[m[0]] if m else 0.0, given[m] // words if words else 0, given[m] % words if words else 0)
        for m, words in found.items()
    ]
    plan_df = spark.createDataFrame(
        plan, "members array<string>, source_size long, target double, whole long, rest long"
    )
    cuts = spark.createDataFrame(
        [(m, rest, 0, "") for m, _, _, _, rest in plan], "members array<string>, rest long, before long, prefix string"
    )
    for level in range(ROUNDS):
        inside = sized.alias("a").join(small(cuts.alias("b")), F.col("a.members").eqNullSafe(F.col("b.members"))).filter(
            F.col("h").startswith(F.col("prefix"))
        )
        sums = inside.groupBy(
            F.col("b.members").alias("members"), "rest", "before", "prefix",
            F.substring("h", DIGITS * level + 1, DIGITS).alias("d"),
        ).agg(F.sum("size").alias("s"))
        run = F.sum("s").over(Window.partitionBy("members").orderBy("d"))
        ends = (
            sums.withColumn("run", F.col("before") + run)
            .filter(F.col("run") > F.col("rest"))
            .groupBy("members")
            .agg(F.min(F.struct("d", "rest", "prefix", (F.col("run") - F.col("s")).alias("before"))).alias("x"))
        )
        # One row for each pattern, as above.
        rows = ends.select(
            "members", "x.rest", "x.before", F.concat("x.prefix", "x.d").alias("prefix")
        ).collect()
        cuts = spark.createDataFrame(rows, cuts.schema)
    joined = (
        sized.alias("a")
        .join(small(plan_df.alias("p")), F.col("a.members").eqNullSafe(F.col("p.members")))
        .join(small(cuts.alias("c")), F.col("a.members").eqNullSafe(F.col("c.members")), "left")
        .select(
            "doc_id", "h", "size", "source_size", "target", "whole", F.col("p.rest").alias("rest"), "before",
            F.col("a.members").alias("members"),
            F.coalesce("prefix", F.lit("")).alias("prefix"),
            F.substring("h", 1, DIGITS * ROUNDS).alias("here"),
        )
    )
    taken = lambda part: (F.col("whole") * F.col("size") + part).cast("long").alias("taken")
    out = ["doc_id", "size", "source_size", "target"]
    clear = joined.filter(F.col("here") != F.col("prefix")).select(
        *out, taken(F.when(F.col("here") < F.col("prefix"), F.col("size")).otherwise(0))
    )
    upto = F.col("before") + F.sum("size").over(
        Window.partitionBy("members").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    )
    edge = joined.filter(F.col("here") == F.col("prefix")).withColumn("upto", upto).select(
        *out,
        taken(F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("upto") + F.col("size")))),
    )
    return clear.unionByName(edge)


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('0:' || CAST(doc_id AS VARCHAR)) AS h
  FROM {docs}),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss FROM sized GROUP BY source),
weighed AS (
  SELECT source, ss, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
                     WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM by_source),
ordered AS (
  SELECT *, CAST(2 * ss AS DOUBLE) / w AS ratio,
         row_number() OVER (ORDER BY CAST(2 * ss AS DOUBLE) / w, source NULLS LAST) AS k FROM weighed),
levels AS (
  SELECT *, (CAST(1.5 AS DOUBLE) * CAST(sum(ss) OVER () AS DOUBLE)
     - CAST(coalesce(sum(2 * ss) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
     / CAST(sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lv
  FROM ordered),
stop AS (SELECT min(k) AS k0, min_by(lv, k) AS lv0 FROM levels WHERE lv <= ratio),
targets AS (
  SELECT l.source, ss, CASE WHEN k < k0 OR k0 IS NULL THEN CAST(2 * ss AS DOUBLE) ELSE lv0 * w END AS target
  FROM levels l, stop),
quota AS (SELECT *, least(CAST(floor(target + 0.5) AS BIGINT), 2 * ss) AS q FROM targets),
running AS (
  SELECT s.doc_id, s.size, q.ss, q.target, CASE WHEN q.ss = 0 THEN 0 ELSE q.q // q.ss END AS whole,
         CASE WHEN q.ss = 0 THEN 0 ELSE q.q % q.ss END AS rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized s JOIN quota q ON s.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, ss AS source_size, target,
       CAST(whole * size + greatest(0, least(size, rest - upto + size)) AS BIGINT) AS taken
FROM running
"""
