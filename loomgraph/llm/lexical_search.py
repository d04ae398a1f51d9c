"""Ranked lexical search by pipelined term partitioning.

Terms of the items belong to owners, rarest terms to the first, most frequent ones to the last.
Documents are indexed in chunks. A bundle is a set of items on its way through one chunk: it
carries a sparse accumulator per item and document of the chunk, visits the owners one after the
other, and each owner cogroups the bundles with its own posting lists and adds the integer
contributions of its terms. What leaves the last owner are the best documents of each chunk;
a merge within each task and a ranked limit select the best of all.

After every owner the `top`-th best partial score of an item is a lower bound of its final one.
An accumulator whose score and all terms to come cannot reach it is dropped, and once the terms
to come cannot reach it alone, no accumulator is opened: both are exact, as the bounds are strict.

Bounds. Items go in blocks of at most `block_pairs` (item, term) pairs, or one longer item; the
documents are indexed once per block. A block's terms, their counts and its items are what the
driver and a task hold, whatever the number of documents. A chunk has about `chunk_bytes` of text
or one longer text, a bundle at most `bundle_items` items.

Defined results: null texts have no terms. Rows of `items` with one id, null included, are one item
with the terms of all. Rows of `docs` are documents, also where ids repeat; a null id ranks last
among equal scores. Items without a match, and empty tables, give no rows. Other columns are not read."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from loomgraph.llm.textops import CHUNK_BYTES, chunks
from loomgraph.session import Scratch

LETTERS = [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]
#: Bytes of terms with A-Z lowered; all others become a space. Non-ASCII bytes are parts of terms.
FOLDED = bytes((b + 32 if 65 <= b <= 90 else b) if b in LETTERS else 32 for b in range(256))
INDEX = "chunk bigint, n_docs bigint, n_terms bigint, ids array<bigint>, sizes binary, term binary, first binary, doc binary, tf binary"
POSTINGS = "bundle int, chunk bigint, ids array<bigint>, sizes binary, term binary, first binary, doc binary, tf binary"
CARRIED = "bundle int, chunk bigint, ids array<bigint>, item binary, doc binary, score binary"
BEST = "item int, doc_id bigint, score bigint"
LAST = np.iinfo(np.int64).max


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLDED).split(b" ") if text else []


def rows_of(batch: pa.RecordBatch):
    """Rows as dicts, one at a time, as a row may be large."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct item_id, term."""

    def run(batches):
        for whole in batches:
            for b in chunks(whole, "text"):
                ids, terms = [], []
                for i, t in zip(b.column("item_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                    own = set(terms_of(t)) - {b""}
                    ids += [i] * len(own)
                    terms += own
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.binary())], ["item_id", "term"])

    rows = items.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "item_id bigint, term binary").distinct()


def build_index(docs: DataFrame, vocabulary, id_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    """One row per chunk: documents and terms with repeats in all; ids and sizes of the documents that hold
    a term of the vocabulary; its terms, where the posting list of each begins, documents and counts."""

    def run(batches):
        at, seq = {t: i for i, t in enumerate(vocabulary.value)}, TaskContext.get().partitionId() << 32
        for whole in batches:
            for b in chunks(whole, "text", chunk_bytes):
                n_docs = n_terms = 0
                ids, sizes, term, doc, tf = [], [], [], [], []
                for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                    counts = Counter(terms_of(t))
                    counts.pop(b"", None)
                    if not counts:
                        continue
                    n = counts.total()
                    n_docs, n_terms = n_docs + 1, n_terms + n
                    own = at.keys() & counts.keys()
                    if own:
                        term += [at[w] for w in own]
                        tf += [counts[w] for w in own]
                        doc += [len(ids)] * len(own)
                        ids.append(i)
                        sizes.append(n)
                term, doc, tf = (np.array(x, d) for x, d in ((term, np.int32), (doc, np.int32), (tf, np.int64)))
                order = np.argsort(term, kind="stable")
                found, first = np.unique(term[order], return_index=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([seq]), pa.array([n_docs]), pa.array([n_terms]), pa.array([ids], pa.list_(pa.int64())),
                     *(pa.array([x.tobytes()], pa.binary()) for x in (
                         np.array(sizes, np.int64), found, np.append(first, len(term)).astype(np.int64), doc[order], tf[order]))],
                    INDEX.replace(",", "").split()[::2])
                seq += 1

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, INDEX)


def document_counts(index: DataFrame, n_terms: int) -> np.ndarray:
    """Documents of each term; a task sends one row per term it has met."""

    def run(batches):
        total = np.zeros(n_terms, np.int64)
        for b in batches:
            for term, first in zip(b.column("term").to_pylist(), b.column("first").to_pylist()):
                total[np.frombuffer(term, np.int32)] += np.diff(np.frombuffer(first, np.int64))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["term", "n"])

    found = index.select("term", "first").mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(n_terms, np.int64)
    for r in found.collect():  # one row per term of the block
        out[r["term"]] = r["n"]
    return out


class Owners:
    """What every owner knows of a block: which terms it owns, the items of each term, weights, and
    for each item how much the terms of this and all later owners can add at most."""

    def __init__(self, items: np.ndarray, terms: np.ndarray, df: np.ndarray, n_items: int, n_docs: int, n_terms: int,
                 owners: int, bundle_items: int, top: int):
        self.n_docs, self.n_terms, self.n_items, self.top, self.bundle_items = n_docs, n_terms, n_items, top, bundle_items
        self.bundles = -(-n_items // bundle_items)
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        fan = np.bincount(terms, minlength=len(df))
        order = np.argsort(df, kind="stable")
        load = np.cumsum((df * fan)[order].astype(np.float64))
        # The last owner takes about half of all additions, the one before a quarter, and so on.
        ends = (load[-1] if len(load) else 0.0) / 2.0 ** np.arange(owners - 1, -1, -1)
        self.owner = np.empty(len(df), np.int32)
        self.owner[order] = np.minimum(np.searchsorted(ends, load, "left"), owners - 1)
        by_term = np.lexsort((items, terms))
        self.weight, self.items = weight, items[by_term].astype(np.int32)
        self.first = np.searchsorted(terms[by_term], np.arange(len(df) + 1))
        self.to_come = np.zeros((owners + 1, n_items), np.int64)
        for s in range(owners):
            mine = self.owner[terms] >= s
            np.add.at(self.to_come[s], items[mine], weight[terms[mine]] * 1_000_000)  # a contribution is below 10^6 times the weight

    def uses(self, bundle: int) -> np.ndarray:
        """Which terms the items of a bundle have."""
        lo = bundle * self.bundle_items
        own = (self.items >= lo) & (self.items < lo + self.bundle_items)
        out = np.zeros(len(self.owner), bool)
        out[np.repeat(np.arange(len(self.owner)), np.diff(self.first))[own]] = True
        return out

    def bundle_items_of(self, term: int, bundle: int) -> np.ndarray:
        own = self.items[self.first[term]: self.first[term + 1]]
        lo = bundle * self.bundle_items
        i, j = np.searchsorted(own, (lo, lo + self.bundle_items))
        return own[i:j] - lo


def postings(index: DataFrame, plan, stage: int) -> DataFrame:
    """The posting lists of one owner, for each bundle that has a term of them."""

    def run(batches):
        p = plan.value
        used = [p.uses(k) for k in range(p.bundles)]
        for b in batches:
            for r in rows_of(b):
                term, first = np.frombuffer(r["term"], np.int32), np.frombuffer(r["first"], np.int64)
                doc, tf = np.frombuffer(r["doc"], np.int32), np.frombuffer(r["tf"], np.int64)
                for bundle in range(p.bundles):
                    mine = (p.owner[term] == stage) & used[bundle][term]
                    if not mine.any():
                        continue
                    lengths = np.diff(first)
                    inside = np.repeat(mine, lengths)
                    starts = np.concatenate(([0], np.cumsum(lengths[mine])))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([bundle], pa.int32()), pa.array([r["chunk"]]), pa.array([r["ids"]], pa.list_(pa.int64())),
                         *(pa.array([x], pa.binary()) for x in (
                             r["sizes"], term[mine].tobytes(), starts.astype(np.int64).tobytes(), doc[inside].tobytes(), tf[inside].tobytes()))],
                        POSTINGS.replace(",", "").split()[::2])

    return index.mapInArrow(run, POSTINGS)


def visit(plan, stage: int, floors: np.ndarray, final: bool):
    """Cogroup function of one owner: bundle rows and posting rows of a (bundle, chunk) to the bundle after it."""

    def run(key, carried: pa.Table, lists: pa.Table) -> pa.Table:
        p, (bundle, chunk) = plan.value, (k.as_py() for k in key)
        have, new = carried.to_pylist(), lists.to_pylist()
        ids = (have or new)[0]["ids"]
        lo = bundle * p.bundle_items
        n = min(p.bundle_items, p.n_items - lo)
        acc = np.zeros((n, len(ids)), np.int64)
        for r in have:
            acc[np.frombuffer(r["item"], np.int32), np.frombuffer(r["doc"], np.int32)] = np.frombuffer(r["score"], np.int64)
        floor, rest = floors[lo: lo + n], p.to_come[stage, lo: lo + n]
        closed = (rest < floor)[:, None] & (acc == 0)  # these terms and all later ones cannot lift a new document
        for r in new:
            term, first = np.frombuffer(r["term"], np.int32), np.frombuffer(r["first"], np.int64).tolist()
            doc, tf = np.frombuffer(r["doc"], np.int32), np.frombuffer(r["tf"], np.int64)
            size = np.frombuffer(r["sizes"], np.int64)
            m = 100 - 50 + (50 * size * p.n_docs) // p.n_terms
            share = (1_000_000_000 * tf) // (1000 * tf + 20 * m[doc])
            for k, t in enumerate(term.tolist()):
                at = slice(first[k], first[k + 1])
                acc[p.bundle_items_of(t, bundle)[:, None], doc[at]] += p.weight[t] * share[at]
        acc[closed] = 0
        item, doc = np.nonzero((acc > 0) & (acc + p.to_come[stage + 1, lo: lo + n][:, None] >= floor[:, None]))
        score = acc[item, doc]
        if final:
            return best_of(item + lo, pa.array([ids[d] for d in doc.tolist()], pa.int64()), score, p.top)
        return pa.table([pa.array([bundle], pa.int32()), pa.array([chunk], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                         *(pa.array([x.tobytes()], pa.binary()) for x in (item.astype(np.int32), doc.astype(np.int32), score))],
                        names=CARRIED.replace(",", "").split()[::2])

    return run


def best_of(item: np.ndarray, ids: pa.Array, score: np.ndarray, top: int) -> pa.Table:
    """The `top` best rows of each item: higher score, then smaller id, null ids last."""
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    order = np.lexsort((ids.fill_null(LAST).to_numpy(), ~known, -score, item))
    place = np.arange(len(order)) - np.searchsorted(item[order], item[order])
    keep = order[place < top]
    return pa.table([pa.array(item[keep].astype(np.int32)), ids.take(pa.array(keep)), pa.array(score[keep])], names=["item", "doc_id", "score"])


def merge_in_task(top: int):
    """Keeps the best rows of each item over all batches of a task."""

    def run(batches):
        held: list[pa.Table] = []
        for b in batches:
            held.append(pa.Table.from_batches([b]))
            if sum(t.num_rows for t in held) > 1 << 18:
                held = [merged(held)]
        if held:
            yield from merged(held).combine_chunks().to_batches()

    def merged(tables: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(tables).combine_chunks()
        ids = t.column("doc_id").combine_chunks() if t.num_rows else pa.array([], pa.int64())
        return best_of(t.column("item").to_numpy(), ids, t.column("score").to_numpy(), top)

    return run


def floors_of(carried: DataFrame, plan, n_items: int, top: int) -> np.ndarray:
    """For each item the `top`-th best partial score, 1 where there are fewer. A task sends its best
    scores of an item; the rank filter takes one of them all."""

    def run(batches):
        kept = [np.zeros(0, np.int64)] * n_items
        for b in batches:
            for r in rows_of(b):
                lo = r["bundle"] * plan.value.bundle_items
                item, score = np.frombuffer(r["item"], np.int32), np.frombuffer(r["score"], np.int64)
                cuts = np.flatnonzero(np.diff(item, prepend=-1))  # items ascend within a row
                for i, own in zip(item[cuts], np.split(score, cuts[1:])):
                    own = np.concatenate((kept[lo + i], own))
                    kept[lo + i] = np.partition(own, len(own) - top)[-top:] if len(own) > top else own
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(n_items, dtype=np.int32), [len(k) for k in kept])), pa.array(np.concatenate(kept))], ["item", "score"])

    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score")))
    best = carried.select("bundle", "item", "score").mapInArrow(run, "item int, score bigint")
    out = np.ones(n_items, np.int64)
    for r in best.withColumn("rank", rank).filter(F.col("rank") == top).collect():  # one row per item
        out[r["item"]] = max(1, r["score"])
    return out


def search_block(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str, top: int, owners: int,
                 bundle_items: int, chunk_bytes: int, scratch: Scratch, name: str) -> DataFrame | None:
    """item_id, doc_id, score of the best rows of each item of one block, over all documents."""
    spark = docs.sparkSession
    got = pairs.toArrow()
    vocabulary, terms = np.unique(np.array(got.column("term").to_pylist(), object), return_inverse=True)
    ids = sorted(set(got.column("item_id").to_pylist()), key=lambda i: (i is None, i or 0))
    place = {i: k for k, i in enumerate(ids)}
    items = np.array([place[i] for i in got.column("item_id").to_pylist()], np.int64)
    words = spark.sparkContext.broadcast(vocabulary.tolist())
    index = scratch.write(f"{name}-index", build_index(docs, words, id_col, text_col, chunk_bytes))
    words.destroy()
    n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    if not n_docs:
        return None
    index = index.filter(F.size("ids") > 0)
    df = document_counts(index, len(vocabulary))
    plan = spark.sparkContext.broadcast(Owners(items, terms, df, len(ids), n_docs, n_terms, owners, bundle_items, top))
    floors = np.ones(len(ids), np.int64)
    bundles = spark.createDataFrame([], CARRIED)
    for s in range(owners - 1):
        lists = postings(index, plan, s)
        met = bundles.groupBy("bundle", "chunk").cogroup(lists.groupBy("bundle", "chunk"))
        bundles = scratch.write(f"{name}-after-{s}", met.applyInArrow(visit(plan, s, floors, False), CARRIED))
        if s:
            scratch.remove(f"{name}-after-{s - 1}")
        floors = floors_of(bundles, plan, len(ids), top)
    lists = postings(index, plan, owners - 1)
    met = bundles.groupBy("bundle", "chunk").cogroup(lists.groupBy("bundle", "chunk"))
    best = met.applyInArrow(visit(plan, owners - 1, floors, True), BEST).mapInArrow(merge_in_task(top), BEST)
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = scratch.write(f"{name}-best", best.withColumn("rank", rank).filter(F.col("rank") <= top))
    for done in (f"{name}-after-{owners - 2}", f"{name}-index"):
        scratch.remove(done)
    plan.destroy()
    keys = spark.createDataFrame(pa.table({"item": pa.array(range(len(ids)), pa.int32()), "item_id": pa.array(ids, pa.int64())}))
    return best.join(F.broadcast(keys), "item").select("item_id", "rank", "doc_id", "score")  # the items of one block


def lexical_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                   item_text: str = "text", top: int = 50, owners: int = 4, bundle_items: int = 512, block_pairs: int = 1 << 20,
                   chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` best documents of every item with a score above 0."""
    scratch = Scratch(docs.sparkSession)
    pairs = scratch.write("pairs", item_terms(items, item_col, item_text))
    parts = -(-pairs.count() // block_pairs)
    while parts > 1:  # more blocks until each is within the bound or a single item
        sizes = pairs.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(parts)).alias("b")).agg(F.count("*").alias("n"), F.min("item_id").alias("i"), F.max("item_id").alias("j"))
        if not sizes.filter((F.col("n") > block_pairs) & (F.col("i") != F.col("j"))).limit(1).count():
            break
        parts *= 2
    out = None
    for k in range(parts):
        block = pairs if parts == 1 else pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k)
        if parts > 1 and block.isEmpty():
            continue
        found = search_block(docs, block, id_col, text_col, top, max(2, owners), bundle_items, chunk_bytes, scratch, f"block-{k}")
        if found is not None:
            out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return out
