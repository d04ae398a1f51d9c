"""Exact dedup by two passes over a Bloom filter with two bits per position.

Pass one counts, for every filter position, whether no, one or more hashes touch it. A hash
whose positions are all touched more than once is possibly repeated; every other text is
certainly alone. Pass two sends only the possibly repeated rows through a shuffle, where the
whole digest decides; the rest pass straight through.

The filter has 16 positions per row up to `max_bits`, its proven size bound on the driver
and in each task. Beyond the bound more rows are possibly repeated and shuffle (id, length and
digest of each, never its text); the result is the same.

Defined results: null text counts as empty, so all empty, blank and null texts form one group.
Ties in length go to the smaller doc_id, null ids last; of rows that tie in that too one stays.
Columns other than the id and the text are not read."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from loomgraph.llm.textops import WORD_SPACE, chunks, field_as_text
from loomgraph.session import materialize

CONTINUATION = bytes(range(0x80, 0xC0))
PROBES, BLOCK = 4, 16


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """row_ord, doc_id, n_points of the original text, sha of the text without white space;
    with `carry` also the whole input row as the struct `row`."""

    def run(batches):
        for whole in batches:
            for b in chunks(field_as_text(whole, "row", text_col) if carry else whole, "text"):
                points, shas = [], []
                for t in b.column("text").cast(pa.binary()).to_pylist():
                    t = t or b""
                    points.append(len(t.translate(None, CONTINUATION)))
                    shas.append(hashlib.sha256(t.translate(None, WORD_SPACE)).digest())
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c) for c in kept), pa.array(points, pa.int64()), pa.array(shas, pa.binary())],
                    [*kept, "n_points", "sha"])

    kept = ["row_ord", "doc_id"] + ["row"] * carry
    rows = docs.select(F.monotonically_increasing_id().alias("row_ord"), F.col(id_col).cast("bigint").alias("doc_id"),
                       F.struct("*").alias("row") if carry else F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, rows.select(*kept).schema.add("n_points", "long").add("sha", "binary"))


def positions(shas: list[bytes], bits: int) -> np.ndarray:
    """Filter positions of each digest, one row of PROBES per digest."""
    two = np.frombuffer(b"".join(s[:16] for s in shas), np.uint64).reshape(-1, 2)
    step = two[:, 1:] | np.uint64(1)
    return (two[:, :1] + step * np.arange(PROBES, dtype=np.uint64)) & np.uint64(bits - 1)


def repeated_filter(rows: DataFrame, bits: int) -> bytes:
    """Packed bits: is the position touched by more than one row? Tasks send the positions
    they touched by block of 65,536; a block is merged in one small group."""

    def touched(batches):
        for b in batches:
            if not b.num_rows:
                continue
            at, n = np.unique(positions(b.column("sha").to_pylist(), bits), return_counts=True)
            block = (at >> np.uint64(BLOCK)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(block, prepend=-1))
            low = (at & np.uint64((1 << BLOCK) - 1)).astype(np.uint16)
            many = (n > 1).astype(np.uint8)
            ends = [*cuts[1:], len(at)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(block[cuts]), pa.array([low[i:j].tobytes() for i, j in zip(cuts, ends)], pa.binary()),
                 pa.array([many[i:j].tobytes() for i, j in zip(cuts, ends)], pa.binary())], ["block", "low", "many"])

    def merge(key, parts):
        seen = np.zeros(1 << BLOCK, np.uint8)
        for low, many in zip(parts.column("low").to_pylist(), parts.column("many").to_pylist()):
            at = np.frombuffer(low, np.uint16)
            seen[at] = np.minimum(2, seen[at] + 1 + np.frombuffer(many, np.uint8))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(seen > 1).tobytes()], pa.binary())})

    out = np.zeros(bits // 8, np.uint8)
    merged = (rows.select("sha").mapInArrow(touched, "block bigint, low binary, many binary")
              .groupBy("block").applyInArrow(merge, "block bigint, bits binary"))
    for r in merged.collect():  # at most bits / 8 bytes
        part = np.frombuffer(r["bits"], np.uint8)
        out[r["block"] << (BLOCK - 3):][: len(part)] = part[: len(out)]
    return out.tobytes()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 1 << 28) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, one row per input row."""
    rows = materialize(digest_rows(docs, id_col, text_col))
    maybe = flag_repeated(rows, *build_filter(rows, max_bits))
    groups = materialize(
        maybe.filter("maybe").groupBy("sha").agg(
            F.min(F.struct(-F.col("n_points"), F.col("doc_id").isNull(), "doc_id", "row_ord")).alias("best"),
            F.count(F.lit(1)).alias("group_size"))
        .select(F.col("sha").alias("group_sha"), "group_size", F.col("best.doc_id").alias("keep_id"),
                F.col("best.row_ord").alias("best_ord")))
    sha = F.lower(F.hex("sha")).alias("text_sha256")
    alone = maybe.filter("not maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), sha)
    return alone.unionByName(
        maybe.filter("maybe").join(groups, F.col("sha") == F.col("group_sha")).select(
            "doc_id", "keep_id", "group_size", (F.col("row_ord") == F.col("best_ord")).alias("kept"), sha))


def build_filter(rows: DataFrame, max_bits: int):
    """Broadcast filter and its number of bits, sized by the number of rows up to the bound."""
    wanted = 1 << max(20, (16 * max(1, rows.count()) - 1).bit_length())
    bits = min(wanted, 1 << (max_bits.bit_length() - 1))
    return rows.sparkSession.sparkContext.broadcast(repeated_filter(rows, bits)), bits


def flag_repeated(rows: DataFrame, shared, bits: int) -> DataFrame:
    """`rows` and maybe: false only for a digest that occurs once."""

    def probe(batches):
        packed = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            if b.num_rows:
                at = positions(b.column("sha").to_pylist(), bits)
                hit = (packed[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1
                yield b.append_column("maybe", pa.array(hit.all(axis=1)))

    return rows.mapInArrow(probe, StructType([*rows.schema, StructField("maybe", BooleanType())]))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 1 << 28) -> DataFrame:
    """The rows of `docs` that stay, with all their columns. Only possibly repeated rows move,
    combined on the map side first, so a hot text costs each task one row."""
    rows = digest_rows(docs, id_col, text_col, carry=True)
    flagged = flag_repeated(rows, *build_filter(materialize(rows.select("sha")), max_bits))
    best = F.struct("n_points", F.col("doc_id").isNotNull(), -F.col("doc_id"), F.xxhash64(F.col("row")[text_col]))
    one = flagged.filter("maybe").groupBy("sha").agg(F.max_by("row", best).alias("row"))
    return flagged.filter("not maybe").select("row.*").unionByName(one.select("row.*"))
