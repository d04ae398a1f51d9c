"""Mixing sources to target weights as a min-cost flow.

Documents are aggregated by membership pattern, the set of sources they belong to. Flow runs
from each pattern to the quotas of its sources. A pattern offers its tokens once at cost 1,
a second time at cost 2, a third at cost 4, so repetition is convex: fresh text goes first.
The flow's amount for a pattern is then turned into documents: every document is taken as
often as the whole passes say, and the rest of a pass is filled in the order of a seeded hash.

Only pattern totals reach the driver, at most `max_patterns` of them (more raise an error).
The rest of a pass is found without a global order: documents of a pattern fall in hash
buckets of about 2,048 rows; buckets below the cut are taken whole, those above not, and in
the one bucket at the cut documents are taken in hash order as long as they fit.

Defined results: null text has size 0 and is never taken. A null source is a source of its
own, last in order. Documents of several sources count once, in the pattern of them all.
Repeated rows are separate documents. Columns other than those named are not read."""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from loomgraph.session import materialize

PASS_COSTS = (1, 2, 4)
BUCKET_ROWS = 2048


def words_of(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Shares of the whole total by weight; a share stops at `most` times its size and the
    excess goes to the others by weight, until none is above."""
    total, n = float(sum(sizes)), len(sizes)
    out, open_ = [0.0] * n, [i for i in range(n) if sizes[i] > 0]
    left = total
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        gone = set(over)
        open_ = [i for i in open_ if i not in gone]
    return out


def min_cost_flow(patterns: list[tuple[list[int], int]], quotas: list[int], costs=PASS_COSTS) -> list[int]:
    """Tokens drawn from each pattern (sources, capacity) so that the quotas are met as far as
    capacities allow, at least cost. Successive shortest paths with potentials on the graph
    start -> pattern (an arc for each pass) -> source -> end."""
    p, s = len(patterns), len(quotas)
    start, end = p + s, p + s + 1
    graph: list[list[int]] = [[] for _ in range(p + s + 2)]
    to, cap, cost = [], [], []

    def arc(a, b, c, w):
        for x, y, z, v in ((a, b, c, w), (b, a, 0, -w)):
            graph[x].append(len(to))
            to.append(y), cap.append(z), cost.append(v)

    passes = []
    for i, (members, tokens) in enumerate(patterns):
        passes.append([])
        for w in costs:
            passes[-1].append(len(to))
            arc(start, i, tokens, w)
        for m in members:
            arc(i, p + m, tokens * len(costs), 0)
    for j, q in enumerate(quotas):
        arc(p + j, end, q, 0)
    height = [0] * (p + s + 2)
    while True:
        dist, back = [math.inf] * (p + s + 2), [-1] * (p + s + 2)
        dist[start] = 0
        queue = [(0, start)]
        while queue:
            d, x = heapq.heappop(queue)
            if d > dist[x]:
                continue
            for e in graph[x]:
                if cap[e] and d + cost[e] + height[x] - height[to[e]] < dist[to[e]]:
                    dist[to[e]] = d + cost[e] + height[x] - height[to[e]]
                    back[to[e]] = e
                    heapq.heappush(queue, (dist[to[e]], to[e]))
        if dist[end] == math.inf:
            break
        height = [h + d if d < math.inf else h for h, d in zip(height, dist)]
        path, x = [], end
        while x != start:
            path.append(back[x])
            x = to[back[x] ^ 1]
        amount = min(cap[e] for e in path)
        for e in path:
            cap[e] -= amount
            cap[e ^ 1] += amount
    return [sum(cap[e ^ 1] for e in arcs) for arcs in passes]


def route(patterns: list[tuple[list[int], int]], quotas: list[int]) -> list[int]:
    """`min_cost_flow` on each connected part of patterns and sources by itself."""
    parent = list(range(len(quotas)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for members, _ in patterns:
        for m in members[1:]:
            parent[root(m)] = root(members[0])
    parts: dict[int, list[int]] = {}
    for i, (members, _) in enumerate(patterns):
        if members:
            parts.setdefault(root(members[0]), []).append(i)
    out = [0] * len(patterns)
    for part in parts.values():
        sources = sorted({m for i in part for m in patterns[i][0]})
        at = {m: k for k, m in enumerate(sources)}
        flow = min_cost_flow([([at[m] for m in patterns[i][0]], patterns[i][1]) for i in part], [quotas[m] for m in sources])
        for i, f in zip(part, flow):
            out[i] = f
    return out


def fill(sizes: list[int], gap: int) -> list[bool]:
    """Takes, in order, what still fits in the gap; then the one document, if any, whose
    addition leaves the total nearer to it."""
    taken = [False] * len(sizes)
    for i, x in enumerate(sizes):
        if 0 < x <= gap:
            taken[i], gap = True, gap - x
    rest = [(abs(gap - x), i) for i, x in enumerate(sizes) if x and not taken[i] and abs(gap - x) < gap]
    if rest:
        taken[min(rest)[1]] = True
    return taken


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sources: Column | None = None,
                weights=(1, 2, 3), seed: int = 7, max_patterns: int = 1_000_000) -> DataFrame:
    """doc_id, size, source_size, target (both summed over the document's sources), taken, one
    row per input row. `sources` is a string or an array of strings, default column source;
    weights repeat over the sources by code point, null last."""
    at = F.col("source") if sources is None else sources
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), at.alias("at"))
    if not dict(rows.dtypes)["at"].startswith("array"):
        rows = rows.withColumn("at", F.array(F.col("at").cast("string")))
    # An array of one null is the null source; a null or empty array is the same.
    rows = rows.select(
        "doc_id", words_of(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("draw"),
        F.when(F.coalesce(F.size("at"), F.lit(0)) < 1, F.array(F.lit(None).cast("string")))
        .otherwise(F.array_sort(F.array_distinct("at"))).alias("at"))
    # the list as text is the pattern's key: null and strings with commas stay apart
    rows = materialize(rows.withColumn("pattern", F.to_json(F.struct("at"), {"ignoreNullFields": "false"})).drop("at"))
    totals = rows.groupBy("pattern").agg(F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("n"))
    found = totals.limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    plan = plan_of([(r["pattern"], r["tokens"], r["n"]) for r in found], weights)
    spark = docs.sparkSession
    plans = spark.createDataFrame(
        plan, "pattern string, source_size bigint, target double, passes bigint, rest bigint, buckets bigint")
    rows = rows.join(F.broadcast(plans) if len(plan) <= 100_000 else plans, "pattern")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("draw"), "buckets"))
    filled = rows.groupBy("pattern", "bucket", "rest").agg(F.sum("size").alias("tokens"))
    before = F.sum("tokens").over(_by_pattern()) - F.col("tokens")
    cut = materialize(filled.withColumn("before", before).select(
        F.col("pattern").alias("cut_pattern"), F.col("bucket").alias("cut_bucket"), (F.col("rest") - F.col("before")).alias("gap"),
        F.col("tokens").alias("bucket_tokens")))
    rows = rows.join(cut, (F.col("pattern") == F.col("cut_pattern")) & (F.col("bucket") == F.col("cut_bucket")))
    edge = (F.col("gap") > 0) & (F.col("gap") < F.col("bucket_tokens"))
    whole = rows.filter(~edge).withColumn("more", F.col("gap") >= F.col("bucket_tokens"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["draw", "doc_id", "size"], kind="stable").reset_index(drop=True)
        pdf["more"] = fill(pdf["size"].tolist(), int(pdf["gap"].iloc[0]))
        return pdf

    picked = rows.filter(edge).select("doc_id", "size", "source_size", "target", "passes", "draw", "gap", "pattern", "bucket")
    picked = picked.groupBy("pattern", "bucket").applyInPandas(
        choose, StructType([*picked.schema, StructField("more", BooleanType())]))
    columns = ("doc_id", "size", "source_size", "target", "passes", "more")
    both = whole.select(*columns).unionByName(picked.select(*columns))
    return both.select("doc_id", "size", "source_size", "target",
                       (F.col("size") * (F.col("passes") + F.col("more").cast("bigint"))).alias("taken"))


def _by_pattern():
    from pyspark.sql import Window

    return Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)


def plan_of(found: list[tuple[str, int, int]], weights) -> list[tuple]:
    """For each pattern: its sources' size and target, whole passes, tokens of the last pass, buckets."""
    import json

    found = sorted(found)
    members = [json.loads(pattern)["at"] for pattern, _, _ in found]
    names = sorted({m for ms in members for m in ms}, key=lambda m: (m is None, m or ""))
    at = {m: i for i, m in enumerate(names)}
    sizes = [0] * len(names)
    for ms, (_, tokens, _) in zip(members, found):
        for m in ms:
            sizes[at[m]] += tokens
    total = sum(tokens for _, tokens, _ in found)
    # shared documents must not raise the total: sizes are scaled to it for the shares
    scale = total / sum(sizes) if sum(sizes) else 1.0
    want = targets([x * scale for x in sizes], [weights[i % len(weights)] for i in range(len(names))])
    flow = route([([at[m] for m in ms], tokens) for ms, (_, tokens, _) in zip(members, found)], [round(x) for x in want])
    out = []
    for ms, (pattern, tokens, n), f in zip(members, found, flow):
        passes = f // tokens if tokens else 0
        out.append((pattern, sum(sizes[at[m]] for m in ms), float(sum(want[at[m]] for m in ms)),
                    passes, f - passes * tokens, max(1, -(-n // BUCKET_ROWS))))
    return out
