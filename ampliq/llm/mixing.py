"""Mix sources to target weights: min-cost flow over membership patterns, then seeded documents.

Documents that belong to the same set of sources are one node of the flow. A first reading of a document costs
nothing and each further one costs more (convex), so a source is only repeated once nothing unread can serve it.
The flow has one node per membership pattern and source, never one per document.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Whitespace-separated words of a text; null and blank texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quota(sizes: Sequence[int], weights: Sequence[float], share: float, cap: float) -> list[float]:
    """Split share * total by weight; nobody gets more than cap times its size, the excess is shared again.

    Sources fill up in the order of cap * size / weight, so one ordered pass finds the fixed point.
    """
    left, weight = float(share * sum(sizes)), float(sum(weights))
    out = [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (cap * sizes[i] / weights[i], i))
    for at, i in enumerate(order):
        if left * weights[i] / weight < cap * sizes[i]:
            for j in order[at:]:
                out[j] = left * weights[j] / weight
            break
        out[i] = float(cap * sizes[i])
        left, weight = left - out[i], weight - weights[i]
    return out


@dataclass
class _Arc:
    to: int
    room: int
    cost: int
    back: int


class Flow:
    """Successive shortest paths on integer capacities."""

    def __init__(self, nodes: int) -> None:
        self.arcs: list[list[_Arc]] = [[] for _ in range(nodes)]

    def add(self, a: int, b: int, room: int, cost: int) -> _Arc:
        arc = _Arc(b, room, cost, len(self.arcs[b]))
        self.arcs[a].append(arc)
        self.arcs[b].append(_Arc(a, 0, -cost, len(self.arcs[a]) - 1))
        return arc

    def run(self, start: int, end: int) -> int:
        height = [0] * len(self.arcs)
        total = 0
        while True:
            best = [math.inf] * len(self.arcs)
            came: list[tuple[int, _Arc] | None] = [None] * len(self.arcs)
            best[start], queue = 0, [(0, start)]
            while queue:
                d, a = heapq.heappop(queue)
                if d > best[a]:
                    continue
                for arc in self.arcs[a]:
                    step = d + arc.cost + height[a] - height[arc.to]
                    if arc.room > 0 and step < best[arc.to]:
                        best[arc.to] = step
                        came[arc.to] = (a, arc)
                        heapq.heappush(queue, (step, arc.to))
            if came[end] is None:
                return total
            height = [h + d if d < math.inf else h for h, d in zip(height, best)]
            path, at = [], end
            while at != start:
                a, arc = came[at]
                path.append(arc)
                at = a
            moved = min(arc.room for arc in path)
            for arc in path:
                arc.room -= moved
                self.arcs[arc.to][arc.back].room += moved
            total += moved


def route(patterns: Sequence[tuple[tuple, int]], targets: dict, repeats: int) -> list[dict]:
    """Words that each membership pattern gives to each of its sources: [{source: words}, ...].

    patterns: (sources, words). A pattern gives up to `repeats` times its words, the r-th reading at cost r - 1.
    """
    names = list(targets)
    source = {s: 2 + len(patterns) + i for i, s in enumerate(names)}
    net = Flow(2 + len(patterns) + len(names))
    links = []
    for p, (members, words) in enumerate(patterns):
        for r in range(repeats):
            net.add(0, 2 + p, words, r)
        links.append({s: net.add(2 + p, source[s], repeats * words, 0) for s in members})
    for s in names:
        net.add(source[s], 1, math.floor(targets[s]), 0)
    net.run(0, 1)
    return [{s: repeats * words - arc.room for s, arc in of.items()} for of, (_, words) in zip(links, patterns)]


def mix(docs: DataFrame, id_col: str, text_col: str, sources: Column, *, weights: Sequence[float] = (3, 1, 2),
        share: float = 1.5, repeats: int = 2, seed: str = "mix", rows_per_bucket: int = 1024) -> DataFrame:
    """One row per input row: id, size, sources, taken (words that the mix takes, repeats counted), plus the
    plan of its pattern: source_sizes and targets (by source).

    sources: array<string> of the sources a document belongs to (null element: the null source; null or empty
    array: like [null]). Sources are ordered by code point, null last, and take `weights` in turn. Targets are
    computed on integers of words; the document on the edge of a quota gives only the words still missing.
    Null or blank texts have size 0 and are never taken. Repeated rows are separate rows. Empty input: no rows.
    Documents are ordered by md5(seed:id), so reruns agree.

    Skew: a pattern with any share of the rows is cut into hash buckets; only bucket sums are ordered in one
    window, and only the bucket on the edge of a quota is ordered by row.
    """
    spark = docs.sparkSession
    members = F.array_sort(F.array_distinct(F.when(F.coalesce(F.size(sources), F.lit(0)) > 0, sources)
                                            .otherwise(F.array(F.lit(None).cast("string")))))
    ident = F.col(id_col)
    sized = cut_lineage(docs.select(ident.alias("id"), word_count(F.col(text_col)).alias("size"), members.alias("members"),
                                    F.md5(F.concat(F.lit(seed + ":"), F.coalesce(ident.cast("string"), F.lit("")))).alias("h")))
    patterns = [(tuple(r["members"]), r["words"], r["n"]) for r in
                sized.groupBy("members").agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect()]
    names = sorted({s for m, _, _ in patterns for s in m}, key=lambda s: (s is None, [] if s is None else [ord(c) for c in s]))
    held = {s: sum(w for m, w, _ in patterns if s in m) for s in names}
    total = sum(w for _, w, _ in patterns)
    aims = dict(zip(names, quota([held[s] for s in names], [weights[i % len(weights)] for i in range(len(names))],
                                 share * total / max(1, sum(held.values())), repeats)))
    flows = route([(m, w) for m, w, _ in patterns], aims, repeats)
    # Digits of the hash that make a bucket of about rows_per_bucket rows in the largest pattern.
    digits = max(1, math.ceil(math.log(max(n for *_, n in patterns) / rows_per_bucket, 16))) if patterns and \
        max(n for *_, n in patterns) > rows_per_bucket else 1
    schema = T.StructType([
        T.StructField("members", T.ArrayType(T.StringType())), T.StructField("laps", T.LongType()),
        T.StructField("rest", T.LongType()), T.StructField("source_sizes", T.ArrayType(T.LongType())),
        T.StructField("targets", T.ArrayType(T.DoubleType())), T.StructField("flows", T.ArrayType(T.LongType()))])
    rows = []
    for (m, words, _), flow in zip(patterns, flows):
        given = sum(flow.values())
        laps = given // words if words else 0
        rows.append((list(m), laps, given - laps * words, [held[s] for s in m], [aims[s] for s in m], [flow[s] for s in m]))
    plan = spark.createDataFrame(rows, schema)
    bucket = F.substring("h", 1, digits)
    running = Window.partitionBy("members").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = (sized.groupBy("members", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
            .withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
            .join(plan.select(F.col("members").alias("m"), "rest"), F.col("members").eqNullSafe(F.col("m"))).drop("m"))
    edge = (sums.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
            .select(F.col("members").alias("e"), F.col("bucket").alias("edge"), (F.col("rest") - F.col("before")).alias("open")))
    # One row per pattern, as many as were just collected.
    plan = plan.withColumnRenamed("members", "m")
    plan = plan.join(edge, F.col("m").eqNullSafe(F.col("e")), "left").drop("e")
    planned = (sized.join(F.broadcast(plan) if len(patterns) <= 100_000 else plan, F.col("members").eqNullSafe(F.col("m")))
               .drop("m").withColumn("bucket", bucket))
    on_edge = F.coalesce(F.col("bucket") == F.col("edge"), F.lit(False))
    order = Window.partitionBy("members", "bucket").orderBy("h", "id", "size")
    within = (planned.where(on_edge)
              .withColumn("cum", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
              .withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("open") - F.col("cum")))).drop("cum"))
    others = planned.where(~on_edge).withColumn(
        "part", F.when(F.col("bucket") < F.col("edge"), F.col("size")).otherwise(F.lit(0)))
    return within.unionByName(others).select(
        F.col("id").alias(id_col), "size", F.col("members").alias("sources"), "source_sizes", "targets", "flows",
        (F.col("laps") * F.col("size") + F.col("part")).cast("long").alias("taken"))


SQL = r"""
WITH d AS (SELECT doc_id, source, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS h,
                  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM s),
o AS (SELECT *, 2.0::DOUBLE * source_size AS top, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / weight, i) AS r FROM w),
c AS (SELECT *, coalesce(sum(top) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
             sum(weight) OVER (ORDER BY r DESC) AS open_weight FROM o),
t AS (SELECT *, 1.5::DOUBLE * (SELECT sum(source_size)::DOUBLE FROM s) - used AS open_words FROM c),
k AS (SELECT min(r) AS first FROM t WHERE open_words * weight / open_weight < top),
a AS (SELECT source, source_size, CASE WHEN r < coalesce((SELECT first FROM k), r + 1) THEN top
        ELSE (SELECT open_words FROM t, k WHERE r = first) * weight / (SELECT open_weight FROM t, k WHERE r = first) END AS target FROM t),
q AS (SELECT d.*, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE floor(target)::BIGINT // source_size END AS laps,
        CASE WHEN source_size = 0 THEN 0 ELSE floor(target)::BIGINT % source_size END AS rest,
        (sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS cum
      FROM d JOIN a ON d.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target, (laps * size + greatest(0, least(size, rest - cum)))::BIGINT AS taken FROM q
"""


def op6_mix_sources(spark, folder: str) -> DataFrame:
    from ..session import table
    docs = table(spark, folder, "documents")
    return mix(docs, "doc_id", "text", F.array("source")).select(
        "doc_id", "size", F.col("source_sizes")[0].alias("source_size"), F.col("targets")[0].alias("target"), "taken")
