"""Removal of repeated passages by difference-cover anchors.

A window is `window` consecutive words of a document. A word goes if a window that covers it has
a word sequence that starts anywhere else too. Anchors are shorter runs of words, hashed only at
positions whose remainder modulo PERIOD is in a difference cover: for any two positions some
shift below PERIOD brings both to cover remainders, so two equal windows always hold two equal
anchors at the same shift, both hashed. A repeated anchor is extended: the windows that hold
it are compared by an 80-bit hash of all their words, and those found more than once are the
repeated windows.

Documents with equal words repeat all their windows, so they lose all words and only the first of
them takes part in the comparison.

Both comparisons are one shuffle of (hash, row, place). What a task sees more than once among
its own rows is known to be repeated: it sends one token of that hash and spreads the
rest, so a passage in a third of all documents costs each chunk of documents one row of that key.
No pairs are formed. Texts travel once, by row number, evenly; the steps share that exchange.

Defined results: null or blank text has no words and comes out empty. Documents shorter than
a window keep all words. Copies of a document, also those with equal ids, repeat all its
windows. Columns other than id and text are not read. Input rows must come in the same partitions when read
again, as those of a stored table do."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from loomgraph.llm.textops import chunks, flat_bytes, long_array, mix, window_hashes, word_bounds, word_hashes
from loomgraph.session import materialize

PERIOD, COVER = 21, (0, 1, 4, 14, 16)


def _places(row: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Word places at which a run of `size` words stays in its row."""
    n = len(row) - size + 1
    return np.flatnonzero(row[:n] == row[size - 1:]) if n > 0 else np.zeros(0, np.int64)


def _words(column: pa.Array):
    """Bytes, bounds and hashes of all words of a chunk, their row, and each row's first word."""
    raw, offs = flat_bytes(column)
    starts, ends, counts = word_bounds(raw, offs)
    return raw, starts, ends, word_hashes(raw, starts, ends), np.repeat(np.arange(len(counts)), counts), np.cumsum(counts) - counts


def _message(h1: np.ndarray, h2: np.ndarray | None, ords: np.ndarray, at: np.ndarray):
    """Rows (h1, h2, row_ord, at, known) of one chunk. A hash seen here more than once sends one
    token with a null row; its places are known and go to partitions of their own."""
    _, where, times = np.unique(h1 if h2 is None else h1 ^ mix(h2), return_inverse=True, return_counts=True)
    known = times[where] > 1
    firsts = np.zeros(len(times), np.int64)
    firsts[where[::-1]] = np.arange(len(where))[::-1]
    token = firsts[times > 1]
    spread = mix(ords.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + at.astype(np.uint64))
    key = np.concatenate((np.where(known, spread, h1), h1[token]))
    second = [] if h2 is None else [pa.array(np.concatenate((np.where(known, np.uint64(0), h2), h2[token])).astype(np.uint16).view(np.int16))]
    none = np.concatenate((np.zeros(len(ords), bool), np.ones(len(token), bool)))
    return [long_array(key), *second, pa.array(np.concatenate((ords, ords[token])), pa.int64(), mask=none),
            pa.array(np.concatenate((at, at[token])).astype(np.int32), pa.int32()), pa.array(np.concatenate((known, np.zeros(len(token), bool))))]


def _repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """row_ord, at of the places whose key occurs more than once. Rows of a key are neighbours
    after one shuffle and sort; a task streams them and holds one batch."""

    def run(batches):
        last, held = None, None  # key of the previous row, and that row if it was not sent yet
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            cols = [b.column(k).to_numpy() for k in keys]
            known = b.column("known").to_numpy(zero_copy_only=False)
            ords, at = b.column("row_ord"), b.column("at")
            same = np.ones(n, bool)  # as the row before
            same[0] = last is not None and all(c[0] == x for c, x in zip(cols, last)) and not known[0]
            if n > 1:
                same[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in cols])
                same[1:] &= ~known[1:] & ~known[:-1]
            hit = same | known
            hit[:-1] |= same[1:]
            out = pa.RecordBatch.from_arrays([ords, at], ["row_ord", "at"]).filter(pa.array(hit))
            if held is not None and same[0]:
                yield held
            yield out.filter(pc.is_valid(out.column("row_ord")))
            held = None if hit[-1] else b.select(["row_ord", "at"]).slice(n - 1).filter(pc.is_valid(ords.slice(n - 1)))
            last = None if known[-1] else tuple(c[-1] for c in cols)

    order = [*keys, "known"]
    return rows.repartition(*keys).sortWithinPartitions(*order).mapInArrow(run, "row_ord bigint, at int")


def equal_documents(rows: DataFrame, window: int) -> DataFrame:
    """twin_ord and first for documents of at least a window whose words are another row's too:
    first says whether it is the first of them. Written, since it is joined three times."""

    def run(batches):
        for whole in batches:
            for b in chunks(whole, "text"):
                _, _, _, h, row, first = _words(b.column("text"))
                counts = np.bincount(row, minlength=b.num_rows)
                digests = b"".join(xxhash.xxh3_128_digest(h[f: f + n].tobytes()) for f, n in zip(first, counts))
                d = np.frombuffer(digests, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([b.column("row_ord"), pa.array(d[:, 0]), pa.array(d[:, 1])], ["row_ord", "d1", "d2"]).filter(pa.array(counts >= window))

    digests = materialize(rows.select("row_ord", "text").mapInArrow(run, "row_ord bigint, d1 bigint, d2 bigint"))
    groups = materialize(digests.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.min("row_ord").alias("first")).filter("n > 1")
                         .select(F.col("d1").alias("g1"), F.col("d2").alias("g2"), "first"))
    return materialize(digests.join(groups, (F.col("d1") == F.col("g1")) & (F.col("d2") == F.col("g2")))
                       .select(F.col("row_ord").alias("twin_ord"), (F.col("row_ord") == F.col("first")).alias("first")))


def repeated_windows(rows: DataFrame, window: int = 35) -> DataFrame:
    """row_ord and the places (array of int) of its repeated windows, from columns row_ord, text
    and first; rows whose `first` is false are copies and take no part."""
    size = window - PERIOD + 1
    if size < 1:
        raise ValueError(f"windows have at least {PERIOD} words")
    cover = np.isin(np.arange(PERIOD), COVER)

    def anchors(batches):
        for whole in batches:
            for b in chunks(whole, "text"):
                _, _, _, h, row, first = _words(b.column("text"))
                at = _places(row, first, window)  # shorter documents hold no window
                if not len(at):
                    continue
                long = np.zeros(len(first), bool)
                long[row[at]] = True
                at = _places(row, first, size)
                at = at[long[row[at]]]
                at = at[cover[(at - first[row[at]]) % PERIOD]]
                ords = b.column("row_ord").to_numpy()
                yield pa.RecordBatch.from_arrays(_message(window_hashes(h, at, size), None, ords[row[at]], at - first[row[at]]),
                                                 ["h1", "row_ord", "at", "known"])

    def windows(batches):
        for whole in batches:
            for b in chunks(whole, "text"):
                _, _, _, h, row, first = _words(b.column("text"))
                ok = np.zeros(len(h) + 1, bool)
                ok[_places(row, first, window)] = True
                lists = b.column("places")
                places = np.asarray(lists.flatten(), np.int64)
                owner = np.repeat(np.arange(b.num_rows), np.asarray(lists.value_lengths(), np.int64))
                # a window holds the anchor if it starts up to PERIOD - 1 words before it
                mark = np.zeros(len(h) + 1, np.int32)
                anchor = places + first[owner]
                np.add.at(mark, np.maximum(anchor - PERIOD + 1, first[owner]), 1)
                np.add.at(mark, anchor + 1, -1)
                at = np.flatnonzero((np.cumsum(mark) > 0) & ok)
                if len(at):
                    ords = b.column("row_ord").to_numpy()
                    yield pa.RecordBatch.from_arrays(
                        _message(window_hashes(h, at, window), window_hashes(h, at, window, second=True), ords[row[at]], at - first[row[at]]),
                        ["h1", "h2", "row_ord", "at", "known"])

    rows = rows.filter("first is null or first")
    found = _repeated(rows.mapInArrow(anchors, "h1 bigint, row_ord bigint, at int, known boolean"), ["h1"])
    places = found.groupBy("row_ord").agg(F.collect_set("at").alias("places"))
    sent = rows.join(places, "row_ord").mapInArrow(windows, "h1 bigint, h2 smallint, row_ord bigint, at int, known boolean")
    return _repeated(sent, ["h1", "h2"]).groupBy("row_ord").agg(F.collect_set("at").alias("places"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row; with_text adds `kept`, the words that stay."""
    rows = docs.select(F.monotonically_increasing_id().alias("row_ord"), F.col(id_col).cast("bigint").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"))
    twins = equal_documents(rows, window)
    # every step takes all columns of `rows`, so that they read one exchange of texts
    rows = rows.join(twins, F.col("row_ord") == F.col("twin_ord"), "left").drop("twin_ord")
    places = repeated_windows(rows, window)

    def cut(batches):
        for whole in batches:
            for b in chunks(whole, "text"):
                raw, starts, ends, h, row, first = _words(b.column("text"))
                lists = b.column("places")
                owner = np.repeat(np.arange(b.num_rows), np.asarray(lists.value_lengths(), np.int64))
                mark = np.zeros(len(h) + 1, np.int32)
                at = np.asarray(lists.flatten(), np.int64) + first[owner]
                np.add.at(mark, at, 1)
                np.add.at(mark, at + window, -1)
                gone = (np.cumsum(mark)[:-1] > 0) | b.column("first").is_valid().to_numpy(zero_copy_only=False)[row]
                n_words = np.bincount(row, minlength=b.num_rows)
                n_gone = np.bincount(row, gone, b.num_rows)
                bytes_of, kept = raw.tobytes(), []
                for i in range(b.num_rows):
                    s = slice(first[i], first[i] + n_words[i])
                    stay = np.flatnonzero(~gone[s]) + first[i]
                    kept.append(b" ".join([bytes_of[x:y] for x, y in zip(starts[stay].tolist(), ends[stay].tolist())]))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), long_array(n_words), long_array(n_gone), pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                     *[pa.array(kept, pa.binary())] * with_text], ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept"] * with_text])

    out = (rows.join(places, "row_ord", "left")
           .select("row_ord", "doc_id", "text", "first", F.coalesce("places", F.array().cast("array<int>")).alias("places"))
           .mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept binary" * with_text))
    return out.withColumn("kept", F.col("kept").cast("string")) if with_text else out
