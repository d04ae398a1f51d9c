"""Near-duplicate documents by a size-aware heavy-light join on word shingles.

A document's set holds the distinct hashes of its shingles; documents link when the Jaccard
similarity of their sets reaches the threshold. Two linked sets of which the larger has s elements
share at least ceil(threshold * s). In one global order of shingles their first two common ones
therefore lie in the first s - ceil(threshold * s) + 2 of each. Small (light) sets enumerate
all 2-subsets of that prefix; large (heavy) sets enter inverted lists with the single
elements of the prefix that is one shorter. Sets of sizes that can pair across the boundary do both.
The boundary is the size with the least cost, counted over the sizes of all sets.

The order puts frequent shingles last, then shingles of frequent words, so lists stay short.
Frequencies come from sketches of all documents, of fixed size; they only order, so their
collisions change no result.

Equal sets are one class. In each list every class is first compared with one hub only, the class
with the most company for all the lists it sent, and components are formed: the text that near copies stem
from shares all of its lists, a copy not those of its own words. Then the pairs of a list that are still in different
components are compared, which is what an exact answer needs; a group of near copies is by
then one component and makes no pairs. Of these pairs the place of the list's elements in the two orders
drops those that have too many elements of their own before it. The order cannot do so where its sketches are
full. Classes that have more than CROWD others of a size that could link in a list therefore count
the elements that no other such class has, exactly; two of them share none of these, so copies below the threshold make no
pairs, however many they are. A bitmap of about four bits per element bounds the overlap from
above and drops most pairs before whole sets are fetched; what remains is compared exactly.

Defined results: null and blank text has an empty set, links with nothing and is its own
component. Texts with fewer words than a shingle have one element, their whole sequence.
Repeated rows are members of one class. A component whose ids are all null has a null id. Columns
other than id and text are not read. Input rows must come in the same partitions when
read again, as those of a stored table do."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Tuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomgraph.llm.textops import chunks, flat_bytes, long_array, mix, word_bounds, word_hashes, _runs
from loomgraph.session import Scratch, materialize

SKETCH_BITS, BLOCK_BITS = 21, 15
LIGHT_MOST = 512
CROWD = 8
SLICE = 1 << 21  # elements that one group counts


class Rule:
    """Similarity of at least num / den, over shingles of `size` words."""

    def __init__(self, size: int, num: int, den: int):
        self.size, self.num, self.den = size, num, den

    def least(self, n: int) -> int:
        return -(-self.num * n // self.den)

    def prefix(self, n: int, common: int) -> int:
        return n - self.least(n) + common

    @property
    def smallest(self) -> int:
        """Sets below this size link with equal sets only."""
        n = 1
        while self.least(n + 1) > n:
            n += 1
        return n

    def links(self, a: int, b: int, common: int) -> bool:
        return self.den * common >= self.num * (a + b - common)

    def overlap(self, a, b):
        """Common elements that sets of sizes a and b need."""
        return -(-self.num * (a + b) // (self.num + self.den))


def shingles(column: pa.Array, size: int):
    """Word hashes of all rows, the words each shingle spans, its hash, and shingles per row."""
    raw, offs = flat_bytes(column)
    starts, ends, counts = word_bounds(raw, offs)
    h = word_hashes(raw, starts, ends, lower=True)
    first = np.cumsum(counts) - counts
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    base = np.cumsum(n) - n
    at = np.arange(n.sum()) - np.repeat(base - first, n)
    to = np.minimum(at + size, np.repeat(first + counts, n))
    return h, at, to, _runs.runs(h, at, to), base, n


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    _, _, _, runs, base, n = shingles(column, size)
    return [np.unique(runs[i: i + k]) for i, k in zip(base, n)]


def cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def ranked_sets(column: pa.Array, size: int, levels: np.ndarray, word_levels: np.ndarray):
    """Sorted distinct shingle hashes of each row, and their ranks in the order of frequency:
    level of the shingle, then levels of its words, which are whole numbers and so the same
    wherever the shingle stands."""
    h, at, to, runs, base, n = shingles(column, size)
    sums = np.zeros(len(h) + 1, np.int64)
    np.cumsum(word_levels[cells(h)], out=sums[1:])
    rank = levels[cells(runs)].astype(np.int64) << 32 | (sums[to] - sums[at])
    for i, k in zip(base, n):
        s, where = np.unique(runs[i: i + k], return_index=True)
        yield s, rank[i: i + k][where]


def bitmap(s: np.ndarray) -> bytes:
    """One bit per hash modulo the power of two at or above four times the set's size, 64 at least."""
    bits = 1 << max(6, (4 * len(s) - 1).bit_length() if len(s) else 0)
    out = np.zeros(bits, bool)
    out[(s >> np.uint64(20)) & np.uint64(bits - 1)] = True
    return np.packbits(out, bitorder="little").tobytes()


def least_apart(a: bytes, b: bytes, na: int, nb: int) -> int:
    """Least number of elements that are in one of two sets only. A bit set on one side only is at
    least one element of that side only."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2:]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2:]
    only_a, only_b = int(np.bitwise_count(x & ~y).sum()), int(np.bitwise_count(y & ~x).sum())
    # the two numbers differ by as much as the sizes do
    only_a, only_b = max(only_a, only_b + na - nb), max(only_b, only_a + nb - na)
    return only_a + only_b


def may_link(a: bytes, b: bytes, na: int, nb: int, rule: Rule) -> bool:
    return na + nb - least_apart(a, b, na, nb) >= 2 * rule.overlap(na, nb)


def read_sets(rows: DataFrame, rule: Rule, seed: int) -> DataFrame:
    """For each row row_ord, doc_id, n, id and check (halves of the set's digest), bits; and from
    each task its part of the sketches of shingles, then words, as (block, cells)."""
    names = ["row_ord", "doc_id", "n", "id", "check", "bits", "block", "cells"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]

    def run(batches):
        sketch = np.zeros((2, 1 << SKETCH_BITS), np.uint32)
        for whole in batches:
            for b in chunks(whole, "text"):
                h, _, _, runs, base, n = shingles(b.column("text"), rule.size)
                sets = [np.unique(runs[i: i + k]) for i, k in zip(base, n)]
                np.add.at(sketch[0], cells(np.concatenate(sets)), np.uint32(1))
                np.add.at(sketch[1], cells(h), np.uint32(1))
                digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes(), seed) for s in sets), np.int64).reshape(-1, 2)
                k = b.num_rows
                yield pa.RecordBatch.from_arrays(
                    [b.column("row_ord"), b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]),
                     pa.array([bitmap(s) for s in sets], pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary())], names)
        blocks = sketch.reshape(-1, 1 << BLOCK_BITS)
        pack = zstandard.ZstdCompressor(level=1)
        yield pa.RecordBatch.from_arrays(
            [*(pa.nulls(len(blocks), t) for t in types[:6]), pa.array(range(len(blocks)), pa.int64()),
             pa.array([pack.compress(c.tobytes()) for c in blocks], pa.binary())], names)

    return rows.mapInArrow(run, "row_ord bigint, doc_id bigint, n bigint, id bigint, check bigint, bits binary, block bigint, cells binary")


def frequency_levels(parts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Per cell of the shingle sketch 0, or the power of two by which it exceeds twice the mean;
    per cell of the word sketch four times the power of two."""

    def add(key, group):
        total = np.zeros(1 << BLOCK_BITS, np.uint64)
        for c in group.column("cells").to_pylist():
            total += np.frombuffer(zstandard.ZstdDecompressor().decompress(c), np.uint32)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "cells": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((2, 1 << SKETCH_BITS), np.uint64)
    for r in parts.filter("block is not null").select("block", "cells").groupBy("block").applyInArrow(add, "block bigint, cells binary").collect():
        out.reshape(-1, 1 << BLOCK_BITS)[r["block"]] = np.frombuffer(r["cells"], np.uint64)  # 8 bytes a cell in all
    runs = np.maximum(0, np.ceil(np.log2((out[0] + 1) / (2 * out[0].mean() + 4)))).astype(np.uint8)
    return runs, np.rint(4 * np.log2(out[1] + 1.0)).astype(np.uint8)


def boundary(sizes: list[tuple[int, int]], heavier: int, rule: Rule, scan_cost: float = 4.0) -> int:
    """Largest light size. `sizes` counts sets up to LIGHT_MOST by size; `heavier` is the summed
    length of the prefixes above. A subset costs its row; an element of an inverted list
    costs its row and scanning the list, `scan_cost` in all."""
    best, found = math.inf, 0
    for x in [rule.smallest - 1, *(2**k for k in range(4, LIGHT_MOST.bit_length()))]:
        cost = heavier * scan_cost
        for n, f in sizes:
            p = rule.prefix(n, 2)
            cost += f * (p * (p - 1) // 2) * (n <= x) + f * rule.prefix(n, 1) * scan_cost * (n > rule.num * x / rule.den)
        if cost < best:
            best, found = cost, x
    return found


def signatures(s: np.ndarray, rank: np.ndarray, light: int, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """The lists a set enters, and for each how many elements it can share at most with a set whose first
    common elements are those of the list: these and what stands behind the last of them in its order."""
    n = len(s)
    if n < rule.smallest:
        return s[:0], np.zeros(0, np.int64)
    ordered = s[np.lexsort((s, rank))[: rule.prefix(n, 2)]]
    out, most = [], []
    if n <= light:
        pairs = np.array(list(itertools.combinations(range(len(ordered)), 2)))
        # the two may be ordered either way by value; the order of the prefix is the same in both sets
        out.append(mix(ordered[pairs[:, 0]] * np.uint64(0x9E3779B97F4A7C15) + ordered[pairs[:, 1]]))
        most.append(2 + n - 1 - pairs[:, 1])
    if rule.den * n > rule.num * light:
        out.append(ordered[: rule.prefix(n, 1)])
        most.append(n - np.arange(len(out[-1])))
    return np.concatenate(out), np.concatenate(most)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """id, label (least id of its component) of every id in the links a, b. Labels spread along
    links and then jump to the label of their label; a written table cuts each round."""
    edges = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(edges.groupBy(F.col("a").alias("id")).agg(F.least("a", F.min("b")).alias("label")))
    for _ in range(rounds):
        heard = edges.join(labels, edges.b == labels.id).groupBy("a").agg(F.min("label").alias("heard"))
        spread = materialize(labels.join(heard, labels.id == heard.a, "left").select("id", "label", F.least("label", "heard").alias("next")))
        if spread.filter("next <> label").isEmpty():
            return labels
        up = spread.select(F.col("id").alias("up_id"), F.col("next").alias("up"))
        labels = materialize(spread.join(up, spread.next == up.up_id, "left").select("id", F.least("next", "up").alias("label")))
    raise RuntimeError(f"components not settled after {rounds} rounds")


class Join:
    """One run of the join over rows of row_ord, doc_id, text."""

    def __init__(self, rows: DataFrame, rule: Rule):
        self.rows, self.rule = rows, rule
        self.sc, self.scratch = rows.sparkSession.sparkContext, Scratch(rows.sparkSession)
        for seed in range(1, 9):
            parts = materialize(read_sets(rows, rule, seed))
            self.docs = parts.filter("row_ord is not null").drop("block", "cells")
            self.classes = materialize(self.docs.filter("n > 0").dropDuplicates(["id", "check"]).select("id", "row_ord", "n", "bits"))
            # ids are half a digest; in the rare case that two sets share one, digest anew
            self.seed = seed
            if not self.classes.groupBy("id").count().filter("count > 1").limit(1).count():
                break
        self.levels = self.sc.broadcast(frequency_levels(parts))  # of fixed size
        wide = self.classes.filter(F.col("n") >= rule.smallest)
        sizes = [(r["n"], r["count"]) for r in wide.filter(F.col("n") <= LIGHT_MOST).groupBy("n").count().collect()]
        above = wide.filter(F.col("n") > LIGHT_MOST).agg(F.sum(F.col("n") - F.ceil(F.col("n") * rule.num / rule.den) + 1)).first()[0]
        self.light = boundary(sizes, int(above or 0), rule)

    def postings(self) -> DataFrame:
        """list, id, n, most: the elements of all lists with at least two classes; `most` bounds the overlap
        of a linked set that has its first common elements in this list."""
        rule, levels, light, seed = self.rule, self.levels, self.light, self.seed

        def run(batches):
            seen: set[int] = set()
            for whole in batches:
                for b in chunks(whole, "text"):
                    sigs, most, ids, ns = [], [], [], []
                    for s, rank in ranked_sets(b.column("text"), rule.size, *levels.value):
                        i = class_id(s, seed)
                        if i in seen:  # a copy of a document this task has sent
                            continue
                        if len(seen) < 1_000_000:
                            seen.add(i)
                        lists, bounds = signatures(s, rank, light, rule)
                        sigs.append(lists), most.append(bounds), ids.append(i), ns.append(len(s))
                    if sigs:
                        k = [len(x) for x in sigs]
                        yield pa.RecordBatch.from_arrays(
                            [long_array(np.concatenate(sigs)), pa.array(np.repeat(ids, k), pa.int64()), pa.array(np.repeat(ns, k), pa.int64()),
                             pa.array(np.concatenate(most).astype(np.int32))], ["sig", "id", "n", "most"])

        # written in columns: the ids of neighbouring rows are equal and take next to no room
        sent = self.scratch.write("sent", self.rows.select("text").mapInArrow(run, "sig bigint, id bigint, n bigint, most int"))
        shared = materialize(sent.groupBy("sig").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
                             .filter("lo <> hi").select(F.col("sig").alias("list")))
        lists = self.scratch.write("lists", sent.join(shared, F.col("sig") == F.col("list"))
                                   .groupBy("list", "id", "n").agg(F.max("most").alias("most")))
        self.scratch.remove("sent")
        return lists

    def apart(self, pairs: DataFrame) -> DataFrame:
        """a, b, n_a, n_b, apart of distinct pairs: the least number of differing elements by bitmap."""

        def run(batches):
            for batch in batches:
                apart = [least_apart(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("bits_a", "bits_b", "n_a", "n_b")))]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("a", "b", "n_a", "n_b")), pa.array(apart, pa.int64())], ["a", "b", "n_a", "n_b", "apart"])

        info = {x: self.classes.select(F.col("id").alias(f"id_{x}"), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")) for x in "ab"}
        wide = pairs.join(info["a"], F.col("a") == F.col("id_a")).join(info["b"], F.col("b") == F.col("id_b"))
        return wide.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, "a bigint, b bigint, n_a bigint, n_b bigint, apart bigint")

    def may_link(self) -> Column:
        """Condition on the columns of `apart`: the bitmaps do not rule a link out."""
        need = F.ceil(F.lit(self.rule.num) * (F.col("n_a") + F.col("n_b")) / F.lit(self.rule.num + self.rule.den))
        return F.col("n_a") + F.col("n_b") - F.col("apart") >= 2 * need

    def texts_of(self, ids: DataFrame) -> DataFrame:
        """id, text: one document of each class of the distinct ids `need`."""
        wanted = materialize(self.classes.join(ids, F.col("id") == F.col("need")).select("id", F.col("row_ord").alias("ord")))
        return self.rows.join(wanted, F.col("row_ord") == F.col("ord")).select("id", "text")

    def compared(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs a, b that link, from whole sets. Only documents of these pairs send their sets."""
        rule = self.rule
        rows = self.texts_of(pairs.select(F.explode(F.array("a", "b")).alias("need")).distinct())

        def read(batches):
            for whole in batches:
                for b in chunks(whole, "text"):
                    yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([s.tobytes() for s in shingle_sets(b.column("text"), rule.size)], pa.binary())], ["id", "elements"])

        def compare(batches):
            for b in batches:
                for part in chunks(b, "set_a", 8 << 20):
                    good = []
                    for x, y in zip(part.column("set_a").to_pylist(), part.column("set_b").to_pylist()):
                        s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                        good.append(rule.links(len(s), len(t), len(np.intersect1d(s, t, assume_unique=True))))
                    yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

        sets = rows.mapInArrow(read, "id bigint, elements binary")
        side = {x: sets.select(F.col("id").alias(f"id_{x}"), F.col("elements").alias(f"set_{x}")) for x in "ab"}
        both = pairs.select("a", "b").join(side["a"], F.col("a") == F.col("id_a")).join(side["b"], F.col("b") == F.col("id_b"))
        return self.scratch.write(name, both.select("a", "b", "set_a", "set_b").mapInArrow(compare, "a bigint, b bigint"))

    def lists_sent(self) -> Column:
        """How many lists a class of n elements enters, those that it has for itself included."""
        n, rule = F.col("n"), self.rule
        prefix = n - F.ceil(n * rule.num / rule.den) + 1
        return (F.when(n <= self.light, prefix * (prefix + 1) / 2).otherwise(0)
                + F.when(n * rule.den > rule.num * self.light, prefix).otherwise(0))

    def with_hubs(self, lists: DataFrame) -> DataFrame:
        """Links of classes with a hub of one of their lists: each tries the nearest by bitmap."""
        sizes = lists.groupBy(F.col("list").alias("of")).agg(F.count(F.lit(1)).alias("size"))
        company = lists.join(sizes, F.col("list") == F.col("of")).groupBy("id").agg((F.sum("size") / F.max(self.lists_sent())).alias("company"))
        hubs = (lists.join(company, "id").groupBy(F.col("list").alias("hub_list"))
                .agg(F.max_by("id", F.struct("company", "id")).alias("hub")))
        pairs = lists.join(hubs, F.col("list") == F.col("hub_list")).filter("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b"))
        near = (self.apart(pairs.distinct()).filter(self.may_link()).groupBy("b")
                .agg(F.min(F.struct("apart", "a")).alias("x")).select(F.col("x.a").alias("a"), "b"))
        return self.compared(materialize(near), "hubs")

    def own_elements(self, lists: DataFrame) -> DataFrame:
        """known, own of the classes with more than CROWD rows of a size that could link in one list: how many of its
        elements no other of these classes has."""
        rule = self.rule
        # sizes that could link lie in neighbouring bins
        sized = lists.filter(F.col("size") > CROWD).withColumn("bin", F.floor(F.log("n") / math.log(rule.den / rule.num)))
        near = (sized.groupBy("list", "bin").agg(F.count(F.lit(1)).alias("rows"))
                .select("list", "rows", F.explode(F.array(F.col("bin") - 1, "bin", F.col("bin") + 1)).alias("bin"))
                .groupBy(F.col("list").alias("of"), F.col("bin").alias("at")).agg(F.sum("rows").alias("near")).filter(F.col("near") > CROWD))
        ids = materialize(sized.join(near, (F.col("list") == F.col("of")) & (F.col("bin") == F.col("at"))).select(F.col("id").alias("need")).distinct())

        total = self.classes.join(ids, F.col("id") == F.col("need")).agg(F.sum("n")).first()[0]
        slices = max(1, -(-int(total or 0) // SLICE))

        def run(batches):
            """Elements of each slice of the hashes, sorted, with the class of those that a batch has once; 0 and True of others."""
            for whole in batches:
                for b in chunks(whole, "text"):
                    sets = shingle_sets(b.column("text"), rule.size)
                    if not sets:
                        continue
                    every = np.concatenate(sets)
                    ids = np.repeat(b.column("id").to_numpy(), [len(s) for s in sets])
                    found, first, times = np.unique(every, return_index=True, return_counts=True)
                    ids, shared = np.where(times > 1, 0, ids[first]), times > 1
                    part = (found >> np.uint64(20)) % np.uint64(slices)
                    order = np.argsort(part, kind="stable")
                    at = np.searchsorted(part[order], np.arange(slices + 1))
                    cut = [(k, order[i:j]) for k, (i, j) in enumerate(zip(at, at[1:])) if j > i]
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in cut], pa.int64()), *(
                        pa.array([x[o].tobytes() for _, o in cut], pa.binary()) for x in (found, ids, shared))], ["slice", "elements", "ids", "shared"])

        def count(key: Tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Classes of the elements that are nowhere else in the slice, with their number."""
            parts = [(np.frombuffer(e, np.uint64), np.frombuffer(i, np.int64), np.frombuffer(s, bool)) for b in batches
                     for e, i, s in zip(*(b.column(c).to_pylist() for c in ("elements", "ids", "shared")))]
            elements, ids, shared = (np.concatenate(x) for x in zip(*parts))
            _, first, times = np.unique(elements, return_index=True, return_counts=True)
            once = first[(times == 1) & ~shared[first]]
            of, own = np.unique(ids[once], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(own.astype(np.int64))], ["of", "own"])

        own = (self.texts_of(ids).mapInArrow(run, "slice bigint, elements binary, ids binary, shared binary")
               .groupBy("slice").applyInArrow(count, "of bigint, own bigint").groupBy("of").agg(F.sum("own").alias("own")))
        return materialize(ids.join(own, F.col("need") == F.col("of"), "left").select(F.col("need").alias("known"), F.coalesce("own", F.lit(0)).alias("own")))

    def pair_by_pair(self, lists: DataFrame) -> DataFrame:
        """Links a, b between classes of one list that are not connected yet. A link is found in the list of its
        first common elements, so pairs whose bounds there do not reach the overlap they need are none: elements
        that only one set has come first in its order. Between classes that counted their own elements these bound
        the overlap too, and near copies below the threshold end here."""
        counted = self.scratch.write("counted", lists.join(self.own_elements(lists), F.col("id") == F.col("known"), "left").select(
            "list", "id", "n", "label", "most", F.when(F.col("own").isNotNull(), F.least("most", F.col("n") - F.col("own"))).alias("tight")))
        x, y = (counted.select("list", *(F.col(c).alias(f"{c}_{k}") for c in ("id", "n", "label", "most", "tight"))) for k in "ab")
        num, den = self.rule.num, self.rule.den
        most = (F.when(F.col("tight_a").isNotNull() & F.col("tight_b").isNotNull(), F.least("tight_a", "tight_b"))
                .otherwise(F.least("most_a", "most_b")))
        pairs = x.join(y, "list").filter((F.col("id_a") < F.col("id_b")) & (F.col("label_a") != F.col("label_b"))
                                         & (F.col("n_a") * den >= F.col("n_b") * num) & (F.col("n_b") * den >= F.col("n_a") * num)
                                         & (most * (num + den) >= (F.col("n_a") + F.col("n_b")) * num))
        rest = self.apart(pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct())
        return self.compared(materialize(rest.filter(self.may_link()).select("a", "b")), "pairs")

    def labelled(self) -> DataFrame:
        """id, label of the classes that are linked with another class."""
        lists = self.postings()
        links = self.with_hubs(lists)
        labels = components(links)
        tagged = self.scratch.write("tagged", lists.join(labels.withColumnRenamed("id", "known"), F.col("id") == F.col("known"), "left")
                                    .select("list", "id", "n", "most", F.coalesce("label", "id").alias("label")))
        open_ = materialize(tagged.groupBy(F.col("list").alias("of")).agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size"))
                            .filter("lo <> hi").select("of", "size"))
        more = self.pair_by_pair(tagged.join(open_, F.col("list") == F.col("of")).select("list", "id", "n", "most", "label", "size"))
        return labels if more.isEmpty() else components(links.unionByName(more))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """At most `rows` rows in an Arrow batch of the jobs inside, as a bound of the tasks' memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def class_id(s: np.ndarray, seed: int) -> int:
    return int.from_bytes(xxhash.xxh3_128_digest(s.tobytes(), seed)[:8], "little", signed=True)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """row_ord, doc_id, n_shingles, label (of the component; null for empty sets) and component_id of
    each row; documents whose sets have a
    similarity of at least num / den link."""
    rows = docs.select(F.monotonically_increasing_id().alias("row_ord"), F.col(id_col).cast("bigint").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"))
    with arrow_rows(docs.sparkSession, 2000):  # rows here hold two whole sets
        join = Join(rows, Rule(size, num, den))
        labels = join.labelled()
    member = (join.docs.filter("n > 0").groupBy("id").agg(F.min("doc_id").alias("first"))
              .join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("label"), "first"))
    member = materialize(member)
    least = materialize(member.groupBy(F.col("label").alias("part")).agg(F.min("first").alias("component_id")))
    found = materialize(member.join(least, F.col("label") == F.col("part")).select(F.col("id").alias("class"), "label", "component_id"))
    return join.docs.join(found, (F.col("id") == F.col("class")) & (F.col("n") > 0), "left").select(
        "row_ord", "doc_id", F.col("n").alias("n_shingles"), "label",
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one_of_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rule) -> DataFrame:
    """The rows of `docs` that stay: of each component the row with the smallest id, and every
    row without words."""
    found = near_duplicates(docs, id_col, text_col, **rule).withColumnRenamed("row_ord", "found_ord")
    key = F.struct(F.col("doc_id").isNull(), "doc_id", "found_ord")
    kept = materialize(found.filter("n_shingles > 0").groupBy("label").agg(F.min(key).alias("x")).select(F.col("x.found_ord").alias("kept_ord"))
                       .unionByName(found.filter("n_shingles = 0").select(F.col("found_ord").alias("kept_ord"))))
    rows = docs.select(F.monotonically_increasing_id().alias("row_ord"), F.struct("*").alias("row"))
    return rows.join(kept, F.col("row_ord") == F.col("kept_ord"), "left_semi").select("row.*")
