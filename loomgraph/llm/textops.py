"""Byte-level text helpers: bounded chunks, words and word-sequence hashes over Arrow text.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Those are ASCII, so byte
runs of UTF-8 text are the same words as code point runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomgraph.session import ship_package

WORD_SPACE = b" \t\n\x0b\x0c\r"
CHUNK_BYTES = 2 << 20
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(WORD_SPACE)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; -1 for a null id, which is in no held-out part."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(-1))


def bounded_sample(rows: DataFrame, most: int, *key: str) -> DataFrame:
    """At most `most` rows in the order of a hash of the key columns. Tasks send only rows whose
    hash is below twice the share wanted, so what reaches the driver does not grow with them."""
    draw, n = F.xxhash64(F.lit(11), *key), rows.count()
    if n > 2 * most:
        rows = rows.filter(F.pmod(draw, F.lit(1 << 30)) < int(2 * most / n * (1 << 30)) + 1)
    return rows.orderBy(F.pmod(draw, F.lit(1 << 30)), draw, *key).limit(most)


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about `limit` bytes of text; a longer text is a slice by itself."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def field_as_text(batch: pa.RecordBatch, row: str, field: str, name: str = "text") -> pa.RecordBatch:
    """The batch with a field of its struct column as a text column of its own, which shares the
    field's bytes where they are text already: a text is sent to the task once."""
    return batch.append_column(name, pc.cast(pc.struct_field(batch.column(row), [field]), pa.string()))


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows one after the other, and the n + 1 row offsets; null is empty."""
    column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0]: offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def word_bounds(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and how many words each row has."""
    n = len(raw)
    inside = ~IS_SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:n] if n else inside
    after = np.concatenate((inside[1:], [False])) & ~edge[1:] if n else inside
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    counts = np.diff(np.searchsorted(starts, offs))
    return starts, ends, counts


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RunHash:
    """64-bit hashes of runs of a sequence from prefix sums: sum of value * base**position,
    moved back to position 0 by the inverse of the odd base, then mixed with the length."""

    def __init__(self, seed: int):
        self.base = (seed * 0x9E3779B97F4A7C15 | 1) % 2**64
        self.inverse = pow(self.base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up, self.down = self._powers(self.base, n), self._powers(self.inverse, n)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        factors = np.full(n, base, np.uint64)
        factors[0] = 1
        return np.cumprod(factors, dtype=np.uint64)

    def runs(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self.grow(len(values) + 1)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.down[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_runs, _other = RunHash(17), RunHash(19)
LONG_WORD = 64
#: Which bytes of a block of eight belong to the word, by how many are left of it.
LEFT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of the bytes of each word. Blocks of eight bytes are mixed into the hash one after the
    other, for all words at once; a sum of powers would let long words of a regular form collide. Words
    longer than LONG_WORD bytes are rare and hashed one by one."""
    data = LOWER[raw] if lower else raw
    size = ends - starts
    out = mix(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(11))
    eights = np.lib.stride_tricks.sliding_window_view(np.concatenate((data, np.zeros(8, np.uint8))), 8)
    at, done = np.flatnonzero(size <= LONG_WORD), 0
    while len(at):
        left = size[at] - done
        block = np.ascontiguousarray(eights[starts[at] + done]).view(np.uint64).ravel() & LEFT[np.minimum(left, 8)]
        out[at] = mix(out[at] ^ block) * np.uint64(0xD6E8FEB86659FD93)
        at, done = at[left > 8], done + 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i]: ends[i]].tobytes(), 11)
    return out


def window_hashes(hashes: np.ndarray, starts: np.ndarray, size: int, second: bool = False) -> np.ndarray:
    """Hash of `size` consecutive word hashes from each start."""
    return (_other if second else _runs).runs(hashes, starts, starts + size)


def long_array(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64), pa.int64())
