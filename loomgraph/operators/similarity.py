"""Pairwise cosine similarity over whole tables, tile by tile.

Copies of one vector are collapsed first: a group of copies, however large, is one row with a
count, and its inner pairs are counted, not formed. The distinct vectors lie in tiles of
bounded size, each pair of tiles is one group, and a group is multiplied strip by strip; its
result leaves the task only as a histogram, as its k best pairs, or as the pairs above a
floor, in small batches. A group never holds more than two tiles.

Statistics over all pairs, and pairs above a floor, need few tiles, just enough pairs of them to use
every core, until a tile holds TILE_BYTES: so far each vector is sent a fixed number of times, and what is
shuffled grows with the rows while the products are quadratic. For a floor, vectors are numbered by their
nearest pivot, and within a group those of two pivots are compared only if the angle between the pivots,
less the largest angles around them, can reach the floor. Best pairs are sought by pivots as tiles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Tuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loomgraph.functions.text import canon, contains_any, join_tasks, or_empty
from loomgraph.functions.vectors import matrix, unit_rows
from loomgraph.session import materialize

TILE_ROWS = 2048
TILE_BYTES = 32 << 20  # of the vectors of a tile that is multiplied strip by strip
CACHED = 512           # rows of the other tile where the products are only counted
STRIP = 256            # rows of a tile multiplied at once, with up to STRIP * TILE_ROWS / 32 of the other


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """field, id, vec, n: one row per different vector, under its smallest id, with the
    number of nodes that share it. Null and zero vectors have no direction and are left out."""
    usable = vectors.filter(F.exists("vec", lambda x: x != 0))
    return usable.groupBy("field", F.col("vec").cast("array<double>").alias("vec")).agg(
        F.min("id").alias("id"), F.count("*").alias("n")
    )


def checked(distinct: DataFrame) -> DataFrame:
    """Written distinct vectors; raises when lengths differ within a field or a value is not a number."""
    kept = materialize(distinct)
    bad = F.exists("vec", lambda x: F.isnan(x) | x.isNull())
    for r in kept.groupBy("field").agg(
        F.min(F.size("vec")).alias("lo"), F.max(F.size("vec")).alias("hi"), F.min(F.when(bad, F.col("id"))).alias("nan"),
        F.min_by("id", F.size("vec")).alias("short"), F.max_by("id", F.size("vec")).alias("long"),
    ).collect():
        if r["lo"] != r["hi"]:
            raise ValueError(f"vectors of {r['field']} have {r['lo']} to {r['hi']} elements, as {r['short']} and {r['long']}")
        if r["nan"] is not None:
            raise ValueError(f"vector {r['nan']} of {r['field']} holds a value that is not a number")
    return kept


def _tile_count(vectors: DataFrame, tile_rows: int) -> int:
    """Tiles needed for the row bound, and at least enough tile pairs to use every core."""
    rows = vectors.count()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    spread = math.ceil(math.sqrt(2 * cores))
    return max(1, math.ceil(rows / tile_rows), min(spread, math.ceil(rows / 64)))


def _wide_tile_count(vectors: DataFrame, tile_rows: int) -> int:
    """Tiles needed for the bound on bytes, and at least enough tile pairs to keep every core busy."""
    r = vectors.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim")).first()
    most = max(tile_rows, TILE_BYTES // (8 * (r["dim"] or 1)))
    spread = math.ceil(math.sqrt(8 * vectors.sparkSession.sparkContext.defaultParallelism))
    return max(1, math.ceil(r["n"] / most), min(spread, math.ceil(r["n"] / 64)))


def _tile_pairs(distinct: DataFrame, tiles: int) -> DataFrame:
    """Sends each vector to every tile pair its tile takes part in."""
    tile = F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    return distinct.withColumn("_tile", tile).withColumn("_other", other).select(
        "field",
        F.least("_tile", "_other").alias("lo"),
        F.greatest("_tile", "_other").alias("hi"),
        (F.col("_tile") > F.col("_other")).alias("right"),
        *[c for c in distinct.columns if c != "field"],
    )


MAX_PIVOTS = 512
DIRECT_TILES = 8  # up to so many, all pairs of tiles are compared without looking for those that matter


def _few(distinct: DataFrame, tile_rows: int) -> bool:
    """Would looking for pivots cost more than the products it can spare?"""
    return distinct.limit(DIRECT_TILES * tile_rows + 1).count() <= DIRECT_TILES * tile_rows


@dataclass
class TilePlan:
    """Vectors by nearest pivot, the angle each tile spans, and the pairs of tiles that can matter."""

    rows: DataFrame                        # field, id, n, vec, tile
    tiles: dict[str, np.ndarray]           # per field: rows of each tile
    spans: dict[str, np.ndarray]           # per field: largest angle to the pivot
    between: dict[str, np.ndarray]         # per field: angles between pivots

    def reachable(self, field: str, floor: float) -> np.ndarray:
        """Which pairs of tiles may hold a pair of rounded cosine `floor` or more."""
        apart = self.between[field] - self.spans[field][:, None] - self.spans[field][None, :]
        limit = math.acos(min(1.0, max(-1.0, floor - 0.0005))) + 1e-6
        return (apart <= limit) & (self.tiles[field][:, None] > 0) & (self.tiles[field][None, :] > 0)

    def groups(self, chosen: dict[str, np.ndarray], tile_rows: int) -> DataFrame:
        """Sends each vector to every chosen pair of tiles; large tiles are cut into parts."""
        spark = self.rows.sparkSession
        listed = [(f, int(a), int(b), self._parts(f, a, tile_rows), self._parts(f, b, tile_rows))
                  for f, m in chosen.items() for a, b in zip(*np.nonzero(m))]
        plan = spark.createDataFrame(listed, "field string, tile int, other int, parts int, other_parts int")
        part = F.pmod(F.xxhash64("id"), F.col("parts"))
        mine, theirs = F.struct("tile", part.cast("int").alias("part")), F.struct(F.col("other").alias("tile"), F.col("other_part").alias("part"))
        return (
            self.rows.join(plan, ["field", "tile"])
            .withColumn("other_part", F.explode(F.sequence(F.lit(0), F.col("other_parts") - 1)))
            .withColumns({"mine": mine, "theirs": theirs})
            .select("field", F.least("mine", "theirs").alias("lo"), F.greatest("mine", "theirs").alias("hi"),
                    (F.col("mine") > F.col("theirs")).alias("right"), "id", "n", "vec")
        )

    def _parts(self, field: str, tile: int, tile_rows: int) -> int:
        return max(1, math.ceil(self.tiles[field][tile] / tile_rows))


def tile_plan(distinct: DataFrame, tile_rows: int) -> TilePlan:
    """Pivots are at most MAX_PIVOTS vectors per field, in the order of a hash of the id."""
    wanted = min(MAX_PIVOTS, _tile_count(distinct, tile_rows))
    rank = F.row_number().over(W.partitionBy("field").orderBy(F.xxhash64("id"), "id"))
    pivots: dict[str, list] = {}
    for r in distinct.withColumn("rank", rank).filter(F.col("rank") <= wanted).select("field", "vec").collect():
        pivots.setdefault(r["field"], []).append(r["vec"])
    units = {f: unit_rows(np.asarray(v, dtype=np.float64)) for f, v in pivots.items()}

    def assign(batches):
        for b in batches:
            fields = np.asarray(b.column("field").to_pylist(), dtype=object)
            tile, angle = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            for f in set(fields.tolist()):
                at = np.flatnonzero(fields == f)
                cos = unit_rows(matrix(b.column("vec").take(pa.array(at)))) @ units[f].T
                tile[at] = cos.argmax(axis=1)
                angle[at] = np.arccos(np.clip(cos.max(axis=1), -1, 1))
            yield b.append_column("tile", pa.array(tile)).append_column("angle", pa.array(angle))

    kind = distinct.schema["id"].dataType.simpleString()
    rows = materialize(distinct.select("field", "id", "n", "vec").mapInArrow(
        assign, f"field string, id {kind}, n bigint, vec array<double>, tile int, angle double"))
    tiles = {f: np.zeros(len(u), np.int64) for f, u in units.items()}
    spans = {f: np.zeros(len(u)) for f, u in units.items()}
    for r in rows.groupBy("field", "tile").agg(F.count("*").alias("n"), F.max("angle").alias("span")).collect():
        tiles[r["field"]][r["tile"]], spans[r["field"]][r["tile"]] = r["n"], r["span"]
    between = {f: np.arccos(np.clip(u @ u.T, -1, 1)) for f, u in units.items()}
    return TilePlan(rows.drop("angle"), tiles, spans, between)


def _tile_sims(table: pa.Table):
    """Row numbers of both sides, the thousandth-rounded cosines of a tile pair, and which
    entries are pairs (each unordered pair once)."""
    right = table["right"].combine_chunks().to_numpy(zero_copy_only=False)
    units = unit_rows(matrix(table["vec"]))
    if table["lo"][0].as_py() == table["hi"][0].as_py():
        i = j = np.arange(len(units))
        sims = units @ units.T
        valid = np.triu(np.ones(sims.shape, dtype=bool), 1)
    else:
        i, j = np.flatnonzero(~right), np.flatnonzero(right)
        sims = units[i] @ units[j].T
        valid = np.ones(sims.shape, dtype=bool)
    return i, j, np.rint(sims * 1000).astype(np.int32), valid


def _strips(table: pa.Table, tile_rows: int, reach: np.ndarray | None = None):
    """Row numbers i, j of the sides of a strip, their cosines, and which entries are pairs (None: all); over
    the strips each unordered pair of a group comes once. With `reach`, rows lie by `pivot`, and only those
    of pivots that can reach each other are compared."""
    units = unit_rows(matrix(table["vec"]))
    same = table["lo"][0].as_py() == table["hi"][0].as_py()
    right = _column(table, "right")
    lefts, rights = (np.arange(len(units)),) * 2 if same else (np.flatnonzero(~right), np.flatnonzero(right))
    cuts = []
    if reach is not None:
        pivot = _column(table, "pivot")
        lefts, rights = (r[np.argsort(pivot[r], kind="stable")] for r in (lefts, rights))
        cuts = np.flatnonzero(np.diff(pivot[lefts])) + 1
    wide = max(1, STRIP * tile_rows // 32)
    for part in np.split(np.arange(len(lefts)), cuts):
        for at in (part[low:low + STRIP] for low in range(0, len(part), STRIP)):
            i = lefts[at]
            others = np.arange(at[0] if same else 0, len(rights))
            if reach is not None:
                others = others[reach[pivot[i[0]]][pivot[rights[others]]]]
            for to in (others[low:low + wide] for low in range(0, len(others), wide)):
                j = rights[to]
                yield i, j, units[i] @ units[j].T, to[None, :] > at[:, None] if same else None


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table[name].combine_chunks().to_numpy(zero_copy_only=False)


def _pair_table(table: pa.Table, i, j, milli, keep, best: int | None = None) -> pa.Table:
    """The kept entries as (a, b, sim, n_a, n_b) with a < b; all, or the best few."""
    x, y = np.nonzero(keep)
    ids, n = _column(table, "id"), _column(table, "n")
    left, right, m = i[x], j[y], milli[x, y]
    swap = ids[left] > ids[right]
    left, right = np.where(swap, right, left), np.where(swap, left, right)
    if best is not None:
        order = np.lexsort((ids[right], ids[left], -m))[:best]
        left, right, m = left[order], right[order], m[order]
    kind = table.schema.field("id").type
    return pa.table({
        "a": pa.array(ids[left], kind), "b": pa.array(ids[right], kind), "sim": pa.array(m / 1000.0),
        "n_a": pa.array(n[left], pa.int64()), "n_b": pa.array(n[right], pa.int64()),
    })


def _counted(table: pa.Table) -> np.ndarray:
    """Node pairs of a group by rounded similarity, from -1000. Strips fit a core's cache, and what is made of
    their products stays in place."""
    n = _column(table, "n")
    single = (n == 1).all()
    total = np.zeros(2001, dtype=np.int64)
    for i, j, sims, later in _strips(table, CACHED * 32 // STRIP):
        sims *= 1000
        np.rint(sims, out=sims)
        sims += 1000
        milli = sims.astype(np.intp)
        valid = ... if later is None else later
        if single:
            total += np.bincount(milli[valid].ravel(), minlength=2001)
        elif float(n[i].sum()) * float(n[j].sum()) < 2**53:  # so sums of doubles are exact
            total += np.bincount(milli[valid].ravel(), np.outer(n[i], n[j])[valid].ravel().astype(np.float64), 2001).astype(np.int64)
        else:
            np.add.at(total, milli[valid], np.outer(n[i], n[j])[valid])
    return total


def histogram(vectors: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """field, milli, n: how many node pairs have each rounded similarity; at most 2001 rows
    per field, whatever the number of pairs. `vectors` is (field, id, vec)."""

    def count(key, table):
        total = _counted(table)
        seen = np.flatnonzero(total)
        return pa.table({
            "field": pa.array([key[0].as_py()] * len(seen), pa.string()),
            "milli": pa.array(seen - 1000, pa.int32()),
            "n": pa.array(total[seen], pa.int64()),
        })

    distinct = checked(distinct_vectors(vectors))
    between = _tile_pairs(distinct, _wide_tile_count(distinct, tile_rows)).groupBy("field", "lo", "hi").applyInArrow(
        count, "field string, milli int, n bigint"
    )
    within = distinct.filter("n > 1").select(
        "field", F.lit(1000).alias("milli"), F.expr("n * (n - 1) div 2").alias("n")
    )
    return between.unionByName(within).groupBy("field", "milli").agg(F.sum("n").alias("n"))


def stats(vectors: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Exact pair count, min, mean, median and max of the rounded similarities per field,
    read off the histogram."""
    up_to = W.partitionBy("field").orderBy("milli")
    whole = W.partitionBy("field")
    h = (
        histogram(vectors, tile_rows)
        .withColumn("upto", F.sum("n").over(up_to))
        .withColumn("total", F.sum("n").over(whole))
    )
    low, high = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    return h.groupBy("field").agg(
        F.max("total").alias("pairs"),
        (F.min("milli") / 1000).alias("min_sim"),
        (F.sum(F.col("milli") * F.col("n")) / F.max("total") / 1000).alias("mean_sim"),
        ((F.min(F.when(F.col("upto") >= low, F.col("milli")))
          + F.min(F.when(F.col("upto") >= high, F.col("milli")))) / 2000).alias("median_sim"),
        (F.max("milli") / 1000).alias("max_sim"),
    )


def top_pairs(vectors: DataFrame, k: int = 5, tile_rows: int = TILE_ROWS) -> DataFrame:
    """field, a, b, sim: the k most similar node pairs of each field; ties go to the smaller
    (a, b). Of the copies of one vector only the k + 1 smallest ids can take part in such a
    pair, so only those are compared. Pairs within tiles come first; their k-th best is a
    floor that rules out most pairs of tiles."""
    rank = F.row_number().over(W.partitionBy("field", "vec").orderBy("id"))
    usable = vectors.filter(F.exists("vec", lambda x: x != 0)).select(
        "field", "id", F.col("vec").cast("array<double>").alias("vec")
    )
    compared = checked(
        usable.withColumn("rank", rank).filter(F.col("rank") <= k + 1)
        .select("field", "id", "vec", F.lit(1).cast("bigint").alias("n"))
    )

    def best(key, table):
        i, j, milli, valid = _tile_sims(table)
        values = milli[valid]
        bar = np.partition(values, -k)[-k] if len(values) > k else -1001
        return _with_field(key, _pair_table(table, i, j, milli, valid & (milli >= bar), k))

    def best_of(groups):
        return groups.groupBy("field", "lo", "hi").applyInArrow(best, f"field string, {_pair_schema(vectors)}")

    def of(chosen):
        return materialize(best_of(plan.groups(chosen, tile_rows)))

    ranked = F.row_number().over(W.partitionBy("field").orderBy(F.desc("sim"), "a", "b"))
    if _few(compared, tile_rows):
        both = best_of(_tile_pairs(compared, _tile_count(compared, tile_rows))).withColumn("rank", ranked).filter(F.col("rank") <= k)
        return both.select("field", "a", "b", "sim")
    plan = tile_plan(compared, tile_rows)
    inside = of({f: np.eye(len(n), dtype=bool) & (n > 0)[:, None] for f, n in plan.tiles.items()})
    floors = {r["field"]: r["sim"] for r in inside.withColumn("rank", ranked).filter(F.col("rank") == k).collect()}
    across = {f: plan.reachable(f, floors.get(f, -1.0)) & ~np.eye(len(n), dtype=bool) for f, n in plan.tiles.items()}
    both = inside.unionByName(of(across)).withColumn("rank", ranked).filter(F.col("rank") <= k)
    return both.select("field", "a", "b", "sim")


def _with_field(key, table: pa.Table) -> pa.Table:
    return table.add_column(0, "field", pa.array([key[0].as_py()] * len(table), pa.string()))


def _pair_schema(vectors: DataFrame) -> str:
    kind = vectors.schema["id"].dataType.simpleString()
    return f"a {kind}, b {kind}, sim double, n_a bigint, n_b bigint"


def pairs(vectors: DataFrame, floor: float, tile_rows: int = TILE_ROWS) -> DataFrame:
    """field, a, b, sim, node_pairs: every pair of distinct vectors whose rounded similarity
    reaches the floor (-1 keeps the complete store, whose size is quadratic). a and b are
    the smallest ids of their copies and `node_pairs` counts the node pairs a row stands
    for; a row with a = b stands for the pairs among the copies of one vector."""
    distinct = checked(distinct_vectors(vectors))
    return _pairs_of(distinct, floor, tile_rows).select("field", "a", "b", "sim", "node_pairs")


def _pairs_of(distinct: DataFrame, floor: float, tile_rows: int, wanted: str = "all") -> DataFrame:
    """`pairs` of distinct vectors. With marks on them (many, mark, m: whether the copies of a vector are of several
    kinds, else their kind and how many are known), `same` counts the node pairs of one kind, for pairs of vectors of
    one kind each; `wanted` picks those ("one") or the rest ("many")."""
    bar = math.ceil(round(floor * 1000, 6))
    marked = "mark" in distinct.columns
    reach: dict[str, np.ndarray] | None = None
    sent = distinct
    if not _few(distinct, tile_rows):
        plan = tile_plan(distinct.select("field", "id", "n", "vec"), tile_rows)
        reach = {f: plan.reachable(f, bar / 1000) for f in plan.tiles}
        pivots = plan.rows.select("field", "id", F.col("tile").alias("pivot"))
        sent = distinct.join(pivots, ["field", "id"])
    kind = distinct.schema["id"].dataType.simpleString()

    def select(key: Tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = key[0].as_py()
        table = pa.Table.from_batches(list(batches))
        ids, n = _column(table, "id"), _column(table, "n")
        if marked:
            many, m, marks = _column(table, "many"), _column(table, "m"), table["mark"].combine_chunks().dictionary_encode()
            mark = marks.indices.to_numpy(zero_copy_only=False)
        for i, j, sims, later in _strips(table, tile_rows, reach and reach[field]):
            sims *= 1000
            keep = sims >= bar - 0.6
            if later is not None:
                keep &= later
            x, y = np.nonzero(keep)
            milli = np.rint(sims[x, y]).astype(np.int32)
            over = milli >= bar
            left, right, milli = i[x[over]], j[y[over]], milli[over]
            if wanted != "all":
                picked = (many[left] | many[right]) == (wanted == "many")
                left, right, milli = left[picked], right[picked], milli[picked]
            if not len(left):
                continue
            swap = ids[left] > ids[right]
            left, right = np.where(swap, right, left), np.where(swap, left, right)
            same = np.where(mark[left] == mark[right], m[left] * m[right], 0) if marked else np.zeros(len(left), np.int64)
            id_type = table.schema.field("id").type
            whole = pa.table({
                "field": pa.array([field] * len(left), pa.string()), "a": pa.array(ids[left], id_type), "b": pa.array(ids[right], id_type),
                "sim": pa.array(milli / 1000.0), "node_pairs": pa.array(n[left] * n[right], pa.int64()), "same": pa.array(same, pa.int64())})
            yield from whole.to_batches(max_chunksize=10000)

    tiles = _wide_tile_count(distinct, tile_rows)
    between = _tile_pairs(sent, tiles).groupBy("field", "lo", "hi").applyInArrow(
        select, f"field string, a {kind}, b {kind}, sim double, node_pairs bigint, same bigint")
    within = distinct.filter((F.col("n") > 1) & F.lit(bar <= 1000))
    if wanted != "all":
        within = within.filter(F.col("many") == F.lit(wanted == "many"))
    return between.unionByName(within.select(
        "field", F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("sim"), F.expr("n * (n - 1) div 2").alias("node_pairs"),
        (F.expr("m * (m - 1) div 2") if marked else F.lit(0).cast("bigint")).alias("same")))


def node_pairs(similar: DataFrame, vectors: DataFrame) -> DataFrame:
    """field, a, b, sim with every node pair written out, for the similarity document alone,
    whose form lists them."""
    nodes = vectors.select("field", F.col("vec").cast("array<double>").alias("vec"), "id")
    reps = distinct_vectors(vectors).select("field", "vec", F.col("id").alias("rep"))
    copies = nodes.join(reps, ["field", "vec"]).select("field", "rep", "id")
    left = copies.select("field", F.col("rep").alias("a"), F.col("id").alias("id_a"))
    right = copies.select("field", F.col("rep").alias("b"), F.col("id").alias("id_b"))
    return (
        similar.join(left, ["field", "a"]).join(right, ["field", "b"])
        .filter("a <> b or id_a < id_b")
        .select("field", F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "sim")
    )


def family(labels: DataFrame, words: list[str]) -> DataFrame:
    """Nodes whose label contains any of the words."""
    return labels.filter(contains_any("label", words))


def field_texts(contents: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """key, label and the texts compared per field (define, problem, task).

    One row per defined name under its own canonical key (aliases are not followed; the
    last record wins), or per paper that defines nothing, with its title standing in.
    Restricted to `nodes` (column key) when given.
    """
    task = join_tasks("task").alias("task")
    problem = or_empty("problem").alias("problem")
    named = contents.select(
        "pid", F.posexplode("defines").alias("pos", "d"), problem, task
    ).groupBy(canon("d.name").alias("key")).agg(
        F.max(F.struct("pid", "pos", F.col("d.name").alias("label"),
                       or_empty("d.definition").alias("define"), "problem", "task")).alias("v")
    ).select("key", "v.label", "v.define", "v.problem", "v.task")
    title = or_empty("title")
    unnamed = contents.filter(F.coalesce(F.size("defines"), F.lit(0)) == 0).select(
        F.concat(F.lit("paper:"), "pid").alias("key"), F.left(title, F.lit(30)).alias("label"),
        title.alias("define"), problem, task,
    )
    out = named.unionByName(unnamed)
    return out if nodes is None else out.join(nodes.select("key"), "key", "left_semi")


def long_fields(texts: DataFrame) -> DataFrame:
    """(field, id, text) rows from the three text columns."""
    return texts.select(
        F.expr("stack(3, 'define', define, 'problem', problem, 'task', task) as (field, text)"),
        F.col("key").alias("id"),
    ).select("field", "id", "text")


def paper_sets(node_papers: DataFrame) -> DataFrame:
    """key, papers: a 128-bit hash of each node's set of papers together with its size; nodes
    without papers have no row."""
    pairs = node_papers.select("key", "pid").distinct()
    return pairs.groupBy("key").agg(F.struct(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("pid")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "pid")).alias("h2")
    ).alias("papers"))


def overlay(vectors: DataFrame, node_papers: DataFrame, floor: float, nodes: DataFrame | None = None,
            field: str = "problem", tile_rows: int = TILE_ROWS) -> DataFrame:
    """source, target, sim, node_pairs: similarities drawn over the graph, between nodes that do
    not merely stem from the same papers. One row per pair of distinct vectors, under their
    smallest ids, with the number of node pairs it stands for; pairs of nodes with equal
    paper sets are taken off by counting nodes per vector and paper set."""
    known = vectors.filter(F.col("field") == field)
    if nodes is not None:
        known = known.join(nodes.select(F.col("key").alias("id")), "id", "left_semi")
    known = materialize(known.select("field", "id", F.col("vec").cast("array<double>").alias("vec")))
    distinct = checked(distinct_vectors(known))
    reps = distinct.select("vec", F.col("id").alias("rep"))
    members = materialize(
        known.join(reps, "vec").join(paper_sets(node_papers).withColumnRenamed("key", "id"), "id")
        .groupBy("rep", "papers").agg(F.count("*").alias("m"))
    )
    kinds = members.groupBy(F.col("rep").alias("id")).agg(F.count("*").alias("k"), F.min("papers").alias("one"), F.max("m").alias("m"))
    many = F.coalesce(F.col("k") > 1, F.lit(False))
    mark = F.concat_ws(" ", *[F.col(f"one.{c}").cast("string") for c in ("n", "h1", "h2")])
    marked = materialize(distinct.join(kinds, "id", "left").select(
        "field", "id", "n", "vec", many.alias("many"), F.when(~many, mark).otherwise("").alias("mark"),
        F.when(~many, F.coalesce("m", F.lit(0))).otherwise(0).cast("bigint").alias("m")))

    def drawn(similar: DataFrame, same: Column) -> DataFrame:
        left_over = F.col("node_pairs") - same
        return similar.filter(left_over > 0).select(
            F.col("a").alias("source"), F.col("b").alias("target"), "sim", left_over.alias("node_pairs"))

    # a vector whose nodes have one set of papers carries it; only pairs with other vectors meet the table of members
    of_one = drawn(_pairs_of(marked, floor, tile_rows, "one"), F.col("same"))
    if marked.filter("many").isEmpty():
        return of_one
    similar = _pairs_of(marked, floor, tile_rows, "many").drop("same")
    left = members.select(F.col("rep").alias("a"), "papers", F.col("m").alias("m_a"))
    right = members.select(F.col("rep").alias("b"), "papers", F.col("m").alias("m_b"))
    same = (
        similar.select("a", "b").join(left, "a").join(right, ["b", "papers"]).groupBy("a", "b")
        .agg(F.sum(F.when(F.col("a") == F.col("b"), F.expr("m_a * (m_a - 1) div 2")).otherwise(F.expr("m_a * m_b"))).alias("same"))
    )
    return of_one.unionByName(drawn(similar.join(same, ["a", "b"], "left"), F.coalesce("same", F.lit(0))))
