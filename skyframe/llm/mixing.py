"""Mixing sources to target weights by a minimum-cost flow.

A document may belong to several sources. Documents are aggregated by
membership pattern; a flow routes each pattern's words to the quotas of its
sources, where the k-th use of the same words costs more than the (k-1)-th;
then documents are chosen in seeded order, the last one in part, so that every
pattern gives what its flow says, to the word.

Only the pattern totals come to the driver, and their number is checked
against ``max_patterns``. The seeded order is cut by a two-level histogram, so
no task sorts a whole source, however large.
"""

from __future__ import annotations

import json
from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hashable, materialize

#: Hex digits of the digest that name a histogram bucket: 16**3 buckets a pattern.
BUCKET_DIGITS = 3


def water_fill(sizes: list[int], weights: list[int], max_passes: int) -> list[float]:
    """Shares of sum(sizes) by weight, each at most max_passes times its size, the excess reshared by weight."""
    targets = [0.0] * len(sizes)
    open_ = set(range(len(sizes)))
    rest = sum(sizes)
    while open_:
        weight = sum(weights[i] for i in open_)
        above = [i for i in open_ if weights[i] * rest > max_passes * sizes[i] * weight]
        if not above:
            for i in open_:
                targets[i] = weights[i] * rest / weight
            break
        for i in above:
            targets[i] = float(max_passes * sizes[i])
            rest -= max_passes * sizes[i]
            open_.discard(i)
    return targets


def route(totals: list[int], members: list[list[int]], quotas: list[int], max_passes: int) -> list[dict[int, int]]:
    """Words that each pattern sends to each of its sources.

    Costs rise from pass to pass and are the same for all patterns, so shortest
    augmenting paths come pass by pass: each level adds one more use of every
    pattern's words and fills what quotas are open, rerouting where that helps.
    """
    flow: list[dict[int, int]] = [{} for _ in totals]
    need = list(quotas)
    senders: list[set[int]] = [set() for _ in quotas]
    spare = [0] * len(totals)
    for _ in range(max_passes):
        spare = [s + t for s, t in zip(spare, totals, strict=True)]
        while True:
            came: dict[int, tuple[int, int] | None] = {p: None for p, s in enumerate(spare) if s > 0 and members[p]}
            queue, seen, end = deque(came), set(), None
            while queue and end is None:
                p = queue.popleft()
                for s in members[p]:
                    if s in seen:
                        continue
                    seen.add(s)
                    if need[s] > 0:
                        end = (p, s)
                        break
                    for other in senders[s]:
                        if other not in came:
                            came[other] = (p, s)
                            queue.append(other)
            if end is None:
                break
            path, p = [end], end[0]
            while came[p] is not None:
                path.append((came[p][0], came[p][1], p))
                p = came[p][0]
            amount = min(need[end[1]], spare[p], *(flow[x[2]][x[1]] for x in path[1:]))
            need[end[1]] -= amount
            spare[p] -= amount
            for step in path:
                if len(step) == 3:
                    flow[step[2]][step[1]] -= amount
                    if not flow[step[2]][step[1]]:
                        senders[step[1]].discard(step[2])
                flow[step[0]][step[1]] = flow[step[0]].get(step[1], 0) + amount
                senders[step[1]].add(step[0])
    return [{s: n for s, n in sent.items() if n} for sent in flow]


@dataclass(frozen=True)
class Mix:
    """documents: id, size, pattern (JSON list of sources), taken; sources: source, source_size, target; routes: pattern, source, words."""

    documents: DataFrame
    sources: DataFrame
    routes: DataFrame


def count_words(text: Column) -> Column:
    r"""Number of ``[^\x20\x09-\x0D]+`` in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix_sources(
    docs: DataFrame,
    memberships: Column,
    size: Column,
    doc_id: str = "doc_id",
    weights: tuple[int, ...] = (1, 2, 3),
    max_passes: int = 3,
    seed: int = 0,
    max_patterns: int = 4096,
) -> Mix:
    """Mix ``docs`` so that each source nears its share of the total size.

    ``memberships``: array of source names; a null element is a source of its
    own (last in order), repeated names count once, a null or empty array
    belongs nowhere and is never taken. ``weights`` go to the sources in code
    point order, repeating. ``size``: non-negative long, null counts as 0.
    Repeated rows are documents of their own; rows that agree in id share the
    seeded order, so that which of them is cut makes no difference. Rows
    without id are ordered by a hash of their columns, so that many of them
    don't meet in one task. No rows give no rows.
    """
    spark = docs.sparkSession
    key = F.to_json(F.array_sort(F.array_distinct(F.coalesce(memberships, F.array().cast("array<string>")))))
    rows = materialize(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.coalesce(size, F.lit(0)).cast("long").alias("size"),
            key.alias("pattern"),
            F.md5(F.concat(F.lit(f"mix:{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("null"), F.xxhash64(*hashable(docs)).cast("string"))))).alias("at"),
        ),
        "mix",
    ).withColumn("bucket", F.substring("at", 1, BUCKET_DIGITS))

    buckets = materialize(rows.groupBy("pattern", "bucket").agg(F.sum("size").alias("words")), "mixbuckets")
    totals = buckets.groupBy("pattern").agg(F.sum("words").alias("words")).limit(max_patterns + 1).collect()
    if len(totals) > max_patterns:
        raise ValueError(f"more than max_patterns={max_patterns} membership patterns")
    patterns = sorted((r["pattern"], int(r["words"])) for r in totals)
    lists = [json.loads(p) for p, _ in patterns]
    names = sorted({s for x in lists for s in x}, key=lambda s: (s is None, s or ""))
    place = {s: i for i, s in enumerate(names)}
    members = [[place[s] for s in x] for x in lists]
    sizes = [0] * len(names)
    for m, (_, words) in zip(members, patterns, strict=True):
        for s in m:
            sizes[s] += words
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(names))], max_passes)
    flow = route([w for _, w in patterns], members, [int(t + 0.5) for t in targets], max_passes)

    plan = []
    for (pattern, words), sent in zip(patterns, flow, strict=True):
        total = sum(sent.values())
        plan.append((pattern, *(divmod(total, words) if words else (0, 0))))
    plan_df = spark.createDataFrame(plan, "pattern string, passes long, rest long")
    before = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cut = (  # one row a pattern at most: the bucket in which the last pass ends
        buckets.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .join(F.broadcast(plan_df), "pattern")
        .where("before < rest and rest <= before + words")
        .select("pattern", F.col("bucket").alias("cut"), (F.col("rest") - F.col("before")).alias("left"))
    )
    ends = plan_df.join(cut, "pattern", "left")  # bounded by max_patterns
    placed = rows.join(F.broadcast(ends), "pattern")
    passes = F.col("passes") * F.col("size")
    sure = placed.where("cut is null or bucket <> cut").withColumn(
        "taken", passes + F.when(F.col("bucket") < F.col("cut"), F.col("size")).otherwise(0)
    )
    order = Window.partitionBy("pattern").orderBy("at", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    edge = (
        placed.where("bucket = cut")
        .withColumn("seen", F.coalesce(F.sum("size").over(order), F.lit(0)))
        .withColumn("taken", passes + F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("seen"))))
    )
    out = [c if c == "doc_id" else F.col(c) for c in ("doc_id", "size", "pattern", "taken")]
    return Mix(
        sure.select(*out).union(edge.select(*out)).withColumnRenamed("doc_id", doc_id),
        spark.createDataFrame(
            [(s, n, t) for s, n, t in zip(names, sizes, targets, strict=True)],
            "source string, source_size long, target double",
        ),
        spark.createDataFrame(
            [(p[0], names[s], n) for p, sent in zip(patterns, flow, strict=True) for s, n in sent.items()],
            "pattern string, source string, words long",
        ),
    )


def op1_mix(docs: DataFrame) -> DataFrame:
    """The contract's mix: one source a document; doc_id, size, source_size, target, taken (and source)."""
    mix = mix_sources(docs, F.array("source"), count_words(F.col("text")))
    sources = mix.sources.select(
        F.to_json(F.array("source")).alias("pattern"), "source", "source_size", "target"
    )
    return mix.documents.join(F.broadcast(sources), "pattern").select(  # bounded by max_patterns
        "doc_id", "size", "source_size", "target", "taken", "source"
    )


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('mix:0:' || coalesce(cast(doc_id AS varchar), 'null')) AS at,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint AS size FROM documents),
s AS (SELECT source, sum(size)::bigint AS n FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM s),
r AS (SELECT *, sum(n) OVER () AS t, sum(w) OVER () AS ws,
             coalesce(sum(3 * n) OVER o, 0) AS c, coalesce(sum(w) OVER o, 0) AS cw, row_number() OVER (ORDER BY 3.0 * n / w, source NULLS LAST) AS k
      FROM w WINDOW o AS (ORDER BY 3.0 * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, min(CASE WHEN (t - c) * w <= 3 * n * (ws - cw) THEN k END) OVER () AS k0 FROM r),
g AS (SELECT f.source, f.n AS source_size,
             CASE WHEN k0 IS NULL OR k < k0 THEN (3 * n)::double ELSE (w * e.left)::double / e.wleft::double END AS target
      FROM f LEFT JOIN (SELECT t - c AS left, ws - cw AS wleft FROM f WHERE k = k0) e ON true),
p AS (SELECT *, floor(target + 0.5)::bigint AS quota FROM g),
q AS (SELECT d.doc_id, d.size, d.source, p.source_size, p.target,
             CASE WHEN p.source_size > 0 THEN p.quota // p.source_size ELSE 0 END AS passes,
             CASE WHEN p.source_size > 0 THEN p.quota % p.source_size ELSE 0 END AS rest,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.at, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (passes * size + greatest(0, least(size, rest - seen)))::bigint AS taken, source
FROM q
"""
