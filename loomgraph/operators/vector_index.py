"""Vector index: inverted lists with product-quantized codes, and exact re-ranking.

A quantizer is fitted on a bounded sample: list centroids, and for each of `parts` slices of a
vector's distance from its centroid a book of values. Every row of the table is then in the list
of its nearest centroid, as one byte per slice. Lists are cut into blocks of at most `block_rows`
rows, so a list that holds a third of all rows is many blocks.

A search takes a table of queries. Queries are sent to the lists whose centroids are nearest and
bundled by list, so that a block meets a bundle, never a single query. The first pass reads codes
only, and leaves the best rows of each query by approximate score; the second reads vectors only of
blocks that hold such rows, and ranks by exact cosine. How many lists and rows that takes is
measured when fitting: sample rows search the sample exactly, and the smallest numbers that find
`recall` of their neighbours are kept. `exact=True` compares every query with every row instead,
bundle by block.

Vectors are compared by cosine; null vectors, other lengths and zero vectors are in no list."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from loomgraph.schemas import SCORE_FLOOR, TOP_K

CODES = 256  # values of a book: one byte per slice
QUANTIZER = "kind string, number int, data binary"


@dataclass(frozen=True)
class Quantizer:
    """Everything the driver and a task hold of an index; its size depends on the sample alone."""

    centroids: np.ndarray  # lists x dim
    books: np.ndarray      # parts x CODES x width
    probes: int            # lists a query visits
    depth: int             # rows of a query that are ranked exactly

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    def lists_of(self, units: np.ndarray) -> np.ndarray:
        return (units @ self.centroids.T - (self.centroids ** 2).sum(axis=1) / 2).argmax(axis=1)

    def slices(self, m: np.ndarray) -> np.ndarray:
        """Rows cut into parts of equal width, zeros behind the last component."""
        parts, _, width = self.books.shape
        return np.pad(m, ((0, 0), (0, parts * width - m.shape[1]))).reshape(len(m), parts, width)

    def encode(self, units: np.ndarray, lists: np.ndarray) -> np.ndarray:
        cut = self.slices(units - self.centroids[lists])
        return np.stack([nearest(cut[:, p], b) for p, b in enumerate(self.books)], axis=1).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Products of each query's slices with every value of their book: queries x parts x CODES."""
        return np.einsum("qpw,pcw->qpc", self.slices(queries), self.books)

    def near_lists(self, queries: np.ndarray, probes: int) -> np.ndarray:
        score = queries @ self.centroids.T - (self.centroids ** 2).sum(axis=1) / 2
        return np.argsort(-score, axis=1, kind="stable")[:, :probes]

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [("centroids", len(self.centroids), self.centroids.tobytes()), ("books", self.books.shape[0], self.books.tobytes()),
                ("probes", self.probes, None), ("depth", self.depth, None)]
        return spark.createDataFrame(rows, QUANTIZER)

    @staticmethod
    def from_frame(df: DataFrame) -> Quantizer:
        got = {r["kind"]: r for r in df.collect()}
        parts = got["books"]["number"]
        return Quantizer(np.frombuffer(got["centroids"]["data"]).reshape(got["centroids"]["number"], -1),
                         np.frombuffer(got["books"]["data"]).reshape(parts, CODES, -1), got["probes"]["number"], got["depth"]["number"])


@dataclass
class VectorIndex:
    quantizer: Quantizer
    blocks: DataFrame  # list, block, ids, codes, vectors


# --- fitting ------------------------------------------------------------------------------


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - (centres ** 2).sum(axis=1) / 2).argmax(axis=1)


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k centres; an empty one moves to a row of the sample."""
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(len(x), size=k)])
    return centres


def unit_matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of the usable vectors of a column, and which rows those are."""
    fits = np.array(pc.fill_null(pc.equal(pc.list_value_length(column), dim), False))
    flat = column.filter(pa.array(fits)).flatten()
    m = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    length = np.linalg.norm(m, axis=1)
    good = np.isfinite(length) & (length > 0)
    at = np.flatnonzero(fits)[good]
    return m[good] / length[good, None], at


def sample_units(vectors: DataFrame, rows: int) -> np.ndarray:
    """Unit vectors of at most `rows` rows, drawn by a hash of the id over the whole table; tasks cut
    by the hash, so what reaches the driver does not grow with the table."""
    usable = vectors.filter(F.size("vec") > 0)
    draw, n = F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(1 << 30)), usable.count()
    if n > 2 * rows:
        usable = usable.filter(draw < int(2 * rows / n * (1 << 30)) + 1)
    got = usable.select(F.col("vec").cast("array<double>").alias("vec"), draw.alias("d")).orderBy("d").limit(rows).toArrow()
    column = got.column("vec").combine_chunks()
    if not len(column):
        raise ValueError("no vectors to fit an index on")
    sizes = np.array(pc.list_value_length(column))
    return unit_matrix(column, int(np.bincount(sizes).argmax()))[0]


def fit(vectors: DataFrame, lists: int | None = None, parts: int = 16, sample_rows: int = 1 << 14, recall: float = 0.97,
        top: int = TOP_K, seed: int = 7) -> Quantizer:
    """Quantizer for (id, vec). `lists` is the root of the number of rows where not given, at most one
    for 16 sample rows."""
    units = sample_units(vectors, sample_rows)
    rng = np.random.default_rng(seed)
    if lists is None:
        lists = int(vectors.count() ** 0.5)
    lists = max(1, min(lists, len(units) // 16 or 1))
    centroids = k_means(units, lists, 12, rng)
    rest = units - centroids[nearest(units, centroids)]
    width = -(-units.shape[1] // parts)
    cut = np.pad(rest, ((0, 0), (0, parts * width - rest.shape[1]))).reshape(len(rest), parts, width)
    books = np.stack([k_means(cut[:, p], CODES, 8, rng) for p in range(parts)])
    return calibrated(Quantizer(centroids, books, lists, len(units)), units, top, recall)


def calibrated(q: Quantizer, units: np.ndarray, top: int, recall: float, queries: int = 256) -> Quantizer:
    """The least number of lists, then of rows ranked exactly, that find the wanted share of the nearest
    sample rows of the first sample rows."""
    asked = units[:queries]
    top = min(top, len(units))
    wanted = np.argsort(-(asked @ units.T), axis=1, kind="stable")[:, :top]
    lists = q.lists_of(units)
    place = np.argsort(q.near_lists(asked, len(q.centroids)), axis=1)  # of each list in a query's order
    visited = np.take_along_axis(place, lists[wanted], axis=1).ravel()
    probes = int(np.quantile(visited, recall, method="higher")) + 1
    codes, tables = q.encode(units, lists), q.tables(asked)
    depth = []
    for i in range(len(asked)):
        score = asked[i] @ q.centroids[lists].T + tables[i][np.arange(codes.shape[1]), codes].sum(axis=1)
        score[place[i][lists] >= probes] = -np.inf
        order = np.empty(len(units), np.int64)
        order[np.argsort(-score, kind="stable")] = np.arange(len(units))
        depth.append(order[wanted[i]])
    found = np.concatenate(depth)[visited < probes]
    return replace(q, probes=probes, depth=max(top, 2 * (int(np.quantile(found, recall, method="higher")) + 1)))


# --- building -----------------------------------------------------------------------------


def block_schema(id_type) -> StructType:
    return StructType([StructField("list", IntegerType()), StructField("block", LongType()), StructField("ids", ArrayType(id_type)),
                       StructField("codes", BinaryType()), StructField("vectors", BinaryType())])


def build(vectors: DataFrame, q: Quantizer, block_rows: int = 4096) -> DataFrame:
    """Blocks of all usable rows. Rows are dealt by (list, id, row), so a long list spreads over
    partitions; within a block ids ascend."""
    id_type = vectors.schema["id"].dataType

    def assign(batches):
        for b in batches:
            units, at = unit_matrix(b.column("vec"), q.dim)
            keep = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(keep), b.column("vec").take(keep), pa.array(q.lists_of(units).astype(np.int32))], ["id", "vec", "list"])

    def pack(ids: pa.Array, vec: pa.Array, number: int) -> pa.RecordBatch:
        units, _ = unit_matrix(vec, q.dim)
        codes = q.encode(units, np.full(len(units), number))
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
             pa.array([codes.tobytes()], pa.binary()), pa.array([units.tobytes()], pa.binary())], ["list", "ids", "codes", "vectors"])

    def cut(batches):
        rest = None
        for b in batches:
            rest = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            done, rest = full_blocks(rest, False)
            yield from done
        if rest is not None:
            yield from full_blocks(rest, True)[0]

    def full_blocks(t: pa.Table, last: bool):
        t = t.combine_chunks()
        number = t.column("list").to_numpy()
        ends = [*np.flatnonzero(np.diff(number)) + 1, len(number)]
        out, start = [], 0
        for end in ends:
            while end - start >= block_rows or (start < end and (last or end < len(number))):
                stop = min(end, start + block_rows)
                part = t.slice(start, stop - start)
                out.append(pack(part.column("id").combine_chunks(), part.column("vec").combine_chunks(), int(number[start])))
                start = stop
        return out, t.slice(start)

    rows = vectors.select("id", F.col("vec").cast("array<double>").alias("vec"))
    assigned = rows.mapInArrow(assign, StructType([*rows.schema, StructField("list", IntegerType())]))
    dealt = assigned.withColumn("deal", F.monotonically_increasing_id()).repartitionByRange("list", "id", "deal")
    schema = block_schema(id_type)
    packed = dealt.sortWithinPartitions("list", "id", "deal").select("id", "vec", "list").mapInArrow(
        cut, StructType([f for f in schema if f.name != "block"]))
    return packed.withColumn("block", F.monotonically_increasing_id()).select(*schema.names)


def index(vectors: DataFrame, write, **fitting) -> VectorIndex:
    """Fits and builds; `write(name, df)` stores a table and returns it, as `Scratch.write` does, since
    block numbers must stay what they are."""
    q = fit(vectors, **fitting)
    return VectorIndex(q, write("blocks", build(vectors, q)))


# --- searching ----------------------------------------------------------------------------


def bundles(queries: DataFrame, q: Quantizer, probes: int, size: int) -> DataFrame:
    """list, qs, units: queries that visit a list, `size` of them in a bundle on average."""
    qid = queries.schema["qid"].dataType

    def route(batches):
        for b in batches:
            units, at = unit_matrix(b.column("vec"), q.dim)
            near = q.near_lists(units, probes)
            rows = np.repeat(np.arange(len(units)), near.shape[1])
            yield pa.RecordBatch.from_arrays(
                [b.column("qid").take(pa.array(at[rows])), pa.array(near.ravel().astype(np.int32)),
                 pa.array([units[k].tobytes() for k in rows], pa.binary())], ["qid", "list", "unit"])

    asked = queries.select("qid", F.col("vec").cast("array<double>").alias("vec"))
    routed = asked.mapInArrow(route, StructType([StructField("qid", qid), StructField("list", IntegerType()), StructField("unit", BinaryType())]))
    deal = F.pmod(F.xxhash64("qid"), F.lit(max(1, -(-queries.count() // size))))
    return routed.groupBy("list", deal.alias("bundle")).agg(F.collect_list(F.struct("qid", "unit")).alias("qs"))


def bundle_matrix(row: pa.Scalar, dim: int) -> tuple[pa.Array, np.ndarray]:
    qs = row.values
    return qs.field("qid"), np.frombuffer(b"".join(qs.field("unit").to_pylist())).reshape(-1, dim)


def best_columns(score: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the n largest values of each row; of equal ones the first."""
    if score.shape[1] > n:
        cols = np.argsort(-score, axis=1, kind="stable")[:, :n]
    else:
        cols = np.broadcast_to(np.arange(score.shape[1]), score.shape)
    return np.repeat(np.arange(len(score)), cols.shape[1]), cols.ravel()


def search(idx: VectorIndex, queries: DataFrame, top: int = TOP_K, floor: float = SCORE_FLOOR, exact: bool = False,
           probes: int | None = None, depth: int | None = None, bundle: int = 256) -> DataFrame:
    """qid, rank, id, score: for each (qid, vec) the `top` rows of highest cosine, the smaller id first
    in a tie, then those at or above the floor."""
    q = idx.quantizer
    if exact:
        hits = exact_hits(idx, queries, top, bundle)
    else:
        hits = rescored(idx, queries, candidates(idx, queries, probes or q.probes, max(top, depth or q.depth), bundle), bundle)
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return hits.withColumn("rank", rank).filter((F.col("rank") <= top) & (F.col("score") >= floor)).select("qid", "rank", "id", "score")


def hit_schema(idx: VectorIndex, queries: DataFrame) -> StructType:
    return StructType([StructField("qid", queries.schema["qid"].dataType),
                       StructField("id", idx.blocks.schema["ids"].dataType.elementType), StructField("score", DoubleType())])


def exact_hits(idx: VectorIndex, queries: DataFrame, top: int, bundle: int) -> DataFrame:
    """The `top` rows of each block for each query."""
    dim = idx.quantizer.dim

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                qids, units = bundle_matrix(b.column("qs")[k], dim)
                score = units @ np.frombuffer(b.column("vectors")[k].as_py()).reshape(-1, dim).T
                i, j = best_columns(score, top)
                yield pa.RecordBatch.from_arrays(
                    [qids.take(pa.array(i)), b.column("ids")[k].values.take(pa.array(j)), pa.array(score[i, j])], ["qid", "id", "score"])

    everywhere = bundles(queries, idx.quantizer, len(idx.quantizer.centroids), bundle)
    met = idx.blocks.select("list", "ids", "vectors").join(everywhere.select("list", "qs"), "list").select("ids", "vectors", "qs")
    return met.mapInArrow(run, hit_schema(idx, queries))


def candidates(idx: VectorIndex, queries: DataFrame, probes: int, depth: int, bundle: int) -> DataFrame:
    """qid, block, place of the `depth` best rows of each query by approximate score. Reads codes only."""
    q, qid = idx.quantizer, queries.schema["qid"].dataType

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                qids, units = bundle_matrix(b.column("qs")[k], q.dim)
                codes = np.frombuffer(b.column("codes")[k].as_py(), np.uint8).reshape(-1, q.books.shape[0])
                tables = q.tables(units)
                score = np.repeat((units @ q.centroids[b.column("list")[k].as_py()])[:, None], len(codes), axis=1)
                for p in range(codes.shape[1]):
                    score += tables[:, p][:, codes[:, p]]
                i, j = best_columns(score, depth)
                yield pa.RecordBatch.from_arrays(
                    [qids.take(pa.array(i)), pa.array(np.full(len(i), b.column("block")[k].as_py())), pa.array(j.astype(np.int32)),
                     pa.array(score[i, j])], ["qid", "block", "place", "near"])

    met = idx.blocks.select("list", "block", "codes").join(bundles(queries, q, probes, bundle), "list").select("list", "block", "codes", "qs")
    found = met.mapInArrow(run, StructType([StructField("qid", qid), StructField("block", LongType()), StructField("place", IntegerType()), StructField("near", DoubleType())]))
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("near"), "block", "place"))
    return found.withColumn("r", rank).filter(F.col("r") <= depth).select("qid", "block", "place")


def rescored(idx: VectorIndex, queries: DataFrame, found: DataFrame, bundle: int) -> DataFrame:
    """Exact scores of candidates; blocks without one are not read past the join."""
    dim = idx.quantizer.dim

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                want = b.column("want")[k].values
                place = want.field("place").to_numpy()
                asked = unit_matrix(want.field("vec"), dim)[0]
                rows = np.frombuffer(b.column("vectors")[k].as_py()).reshape(-1, dim)[place]
                yield pa.RecordBatch.from_arrays(
                    [want.field("qid"), b.column("ids")[k].values.take(pa.array(place)), pa.array((asked * rows).sum(axis=1))], ["qid", "id", "score"])

    asked = queries.select("qid", F.col("vec").cast("array<double>").alias("vec"))
    deal = F.pmod(F.xxhash64("qid"), F.lit(max(1, -(-queries.count() // bundle))))
    want = found.join(asked, "qid").groupBy("block", deal.alias("bundle")).agg(F.collect_list(F.struct("qid", "place", "vec")).alias("want"))
    met = idx.blocks.select("block", "ids", "vectors").join(want.select("block", "want"), "block").select("ids", "vectors", "want")
    return met.mapInArrow(run, hit_schema(idx, queries))


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """n, hit, share: how many of the exact hits are among the found ones."""
    both = exact.select("qid", "id").join(found.select("qid", "id", F.lit(True).alias("hit")), ["qid", "id"], "left")
    return both.agg(F.count("*").alias("n"), F.count("hit").alias("hit"), (F.count("hit") / F.count("*")).alias("share"))
