"""Centroid clustering over zone maps along a space-filling curve.

Vectors are ordered by a Hilbert curve through their leading principal coordinates and cut into
blocks of `block_rows`, each with its box: the smallest and largest value of every component. The
order comes from a range shuffle, so blocks are formed in the tasks and written once. In every round
a block compares its box with the centroids: one whose least distance to the box exceeds another's
greatest distance can be nearest to no vector inside. What is left are the block's candidates, and
its vectors are compared with those alone, all at once. The bounds are exact integers and not
strict, so ties are kept; the curve decides how many candidates are left, never the result.

A task sends one row of exact sums per cluster and round; the centroids are all that reaches the
driver. Equal vectors are dealt by row over the range partitions, so a vector that holds a third of
all rows is no hot key.

Defined results: only vectors with `dim` components, none null or non-finite, are kept; component x
becomes floor(scale * x). Start centroids that tie in the hash, as ids repeat, go by components.
With fewer kept vectors than `k` there are fewer clusters; none give no rows. A null id hashes as
the empty text after the prefix. Components beyond 2**27 after scaling raise an error, as
distances would leave 64 bits. Other columns are not read."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from loomgraph.session import Scratch

LARGEST = 1 << 27
EXACT_FLOAT = 1 << 20  # below it, sums of dim products stay integers in float64
COORDINATES, BITS = 8, 8  # of the curve: one 64-bit key
BLOCKS = "ids array<bigint>, vectors binary, low binary, high binary"


def kept_vectors(df: DataFrame, id_col: str, vec_col: str, dim: int, scale: int) -> DataFrame:
    """vec_id, v: the scaled components of all usable vectors."""

    def run(batches):
        for b in batches:
            vec = b.column("vec")
            right = pc.fill_null(pc.equal(pc.list_value_length(vec), dim), False)
            part = b.filter(right)
            if not part.num_rows:
                continue
            flat = part.column("vec").flatten()
            x = np.where(flat.is_null().to_numpy(zero_copy_only=False), np.nan, flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64))
            x = x.reshape(-1, dim)
            good = np.isfinite(x).all(axis=1)
            v = np.floor(scale * x[good])
            if (np.abs(v) > LARGEST).any():
                raise ArithmeticError(f"a scaled component is beyond {LARGEST}")
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id").filter(pa.array(good)), list_array(v.astype(np.int64), pa.int32())], ["vec_id", "v"])

    rows = df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return rows.mapInArrow(run, "vec_id bigint, v array<int>")


def list_array(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(m.ravel(), kind))


def as_matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


# --- the curve ----------------------------------------------------------------------------


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of each row of cell numbers (0 to 2**bits - 1) on the Hilbert curve of that many
    dimensions: the cell's coordinates are turned into the transposed index of the curve, bit plane
    by bit plane from the highest, and the planes are interleaved."""
    x = cells.astype(np.uint64).copy()
    n = x.shape[1]
    plane = np.uint64(1 << (bits - 1))
    while plane > 1:
        low = plane - np.uint64(1)
        for i in range(n):
            up = (x[:, i] & plane) > 0
            swap = np.where(up, np.uint64(0), (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(up, low, swap)
            x[:, i] ^= swap
        plane >>= np.uint64(1)
    for i in range(1, n):  # Gray code
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.uint64)
    plane = np.uint64(1 << (bits - 1))
    while plane > 1:
        turn ^= np.where((x[:, n - 1] & plane) > 0, plane - np.uint64(1), np.uint64(0))
        plane >>= np.uint64(1)
    x ^= turn[:, None]
    key = np.zeros(len(x), np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << np.uint64(1)) | ((x[:, i] >> np.uint64(b)) & np.uint64(1))
    return key


def principal_axes(vectors: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Mean, leading axes and spread along them, from sums over all vectors; a task sends `dim` rows."""

    def run(batches):
        n, total, cross = 0, np.zeros(dim), np.zeros((dim, dim))
        for b in batches:
            x = as_matrix(b.column("v"), dim).astype(np.float64)
            n, total, cross = n + len(x), total + x.sum(axis=0), cross + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(dim), pa.int32()), pa.array([float(n)] * dim), pa.array(total), list_array(cross, pa.float64())], ["i", "n", "s", "c"])

    sums = vectors.select("v").mapInArrow(run, "i int, n double, s double, c array<double>").groupBy("i").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), *[F.sum(F.col("c")[j]).alias(f"c{j}") for j in range(dim)])
    got = sorted(sums.collect(), key=lambda r: r["i"])
    if not got:
        return None
    n = got[0]["n"]
    mean = np.array([r["s"] for r in got]) / n
    spread, axes = np.linalg.eigh(np.array([[r[f"c{j}"] for j in range(dim)] for r in got]) / n - np.outer(mean, mean))
    lead = np.argsort(-spread)[:COORDINATES]
    return mean, axes[:, lead], np.sqrt(np.maximum(spread[lead], 1e-9))


def with_key(vectors: DataFrame, frame: tuple, dim: int) -> DataFrame:
    """Adds the position on the curve, as a signed number of the same order. Each coordinate is cut
    into 2**BITS cells over four deviations; what lies beyond is in the outer cells."""
    mean, axes, spread = frame

    def run(batches):
        for b in batches:
            at = (as_matrix(b.column("v"), dim) - mean) @ axes / spread
            cells = np.clip(np.floor((at + 4) * (1 << BITS) / 8), 0, (1 << BITS) - 1)
            key = hilbert_keys(cells, BITS) ^ np.uint64(1 << 63)
            yield b.append_column("key", pa.array(key.view(np.int64)))

    return vectors.mapInArrow(run, "vec_id bigint, v array<int>, key bigint")


def zone_blocks(vectors: DataFrame, dim: int, block_rows: int) -> DataFrame:
    """Blocks of neighbours on the curve with their boxes."""

    def pack(ids: list, m: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([ids], pa.list_(pa.int64())), *(pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in (m, m.min(axis=0), m.max(axis=0)))],
            ["ids", "vectors", "low", "high"])

    def run(batches):
        ids, rest = [], np.zeros((0, dim), np.int64)
        for b in batches:
            ids += b.column("vec_id").to_pylist()
            rest = np.concatenate((rest, as_matrix(b.column("v"), dim)))
            while len(rest) >= block_rows:
                yield pack(ids[:block_rows], rest[:block_rows])
                ids, rest = ids[block_rows:], rest[block_rows:]
        if len(rest):
            yield pack(ids, rest)

    frame = principal_axes(vectors, dim)
    if frame is None:
        return vectors.sparkSession.createDataFrame([], BLOCKS)
    keyed = with_key(vectors, frame, dim).withColumn("deal", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange("key", "deal").sortWithinPartitions("key", "deal")
    return ordered.select("vec_id", "v").mapInArrow(run, BLOCKS)


# --- rounds -------------------------------------------------------------------------------


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to a vector of the box."""
    below, above = low - centroids, centroids - high
    least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(axis=1)
    most = (np.maximum(np.abs(centroids - low), np.abs(high - centroids)) ** 2).sum(axis=1)
    return np.flatnonzero(least <= most.min())


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row, the smaller number in a tie, and its exact squared distance."""
    if max(np.abs(v).max(), np.abs(centroids).max()) <= EXACT_FLOAT:  # |v|**2 of all: constant within a row
        c = centroids.astype(np.float64)
        best = ((c * c).sum(axis=1) - 2 * (v.astype(np.float64) @ c.T)).argmin(axis=1)
    else:
        best = np.stack([((v - c) ** 2).sum(axis=1) for c in centroids]).argmin(axis=0)
    return best, ((v - centroids[best]) ** 2).sum(axis=1)


def assigned(batches, centroids: np.ndarray, dim: int):
    """ids, vectors, cluster numbers and distances of each block."""
    for b in batches:
        for k in range(b.num_rows):
            low, high, v = (np.frombuffer(b.column(c)[k].as_py(), np.int32).astype(np.int64) for c in ("low", "high", "vectors"))
            v = v.reshape(-1, dim)
            near = candidates(low, high, centroids)
            best, distance = nearest(v, centroids[near])
            yield b.column("ids")[k].values, v, near[best], distance


def next_centroids(blocks: DataFrame, centroids: np.ndarray, dim: int) -> np.ndarray:
    k = len(centroids)

    def run(batches):
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for _, v, cluster, _ in assigned(batches, centroids, dim):
            member = (cluster[:, None] == np.arange(k)).astype(np.float64)
            count += np.bincount(cluster, minlength=k)
            total += (member.T @ v).astype(np.int64)  # sums of one block are exact in float64
        own = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(count[own]), list_array(total[own], pa.int64())], ["cluster", "n", "s"])

    sums = blocks.mapInArrow(run, "cluster int, n bigint, s array<bigint>").groupBy("cluster").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("s")[j]).alias(f"s{j}") for j in range(dim)])
    out = centroids.copy()
    for r in sums.collect():  # one row per cluster
        out[r["cluster"]] = [r[f"s{j}"] // r["n"] for j in range(dim)]
    return out


def cluster_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = 64, scale: int = 256, k: int = 40,
                    rounds: int = 5, seed: str = "2:", block_rows: int = 256) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each kept vector."""
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    vectors = scratch.write("vectors", kept_vectors(df, id_col, vec_col, dim, scale))
    drawn = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    start = vectors.select("v", drawn.alias("h")).orderBy("h", "v").limit(k).collect()
    out_ddl = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not start:
        return spark.createDataFrame([], out_ddl)
    blocks = scratch.write("blocks", zone_blocks(vectors, dim, block_rows))
    scratch.remove("vectors")
    centroids = np.array([r["v"] for r in start], np.int64)
    for _ in range(rounds):
        centroids = next_centroids(blocks, centroids, dim)

    def run(batches):
        for ids, _, cluster, distance in assigned(batches, centroids, dim):
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    rows = scratch.write("assigned", blocks.mapInArrow(run, "vec_id bigint, cluster int, distance bigint"))
    scratch.remove("blocks")
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    own = {r["cluster"]: r["n"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    clusters = spark.createDataFrame([(c, n, sum(own.values()), shas[c]) for c, n in own.items()],
                                     "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(clusters), "cluster").select(*(c.split()[0] for c in out_ddl.split(", ")))  # at most k rows
