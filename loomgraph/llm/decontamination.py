"""Benchmark decontamination by pigeonhole edit matching.

Both sides are lower-cased (A-Z) and their words joined by single spaces. An item of m
characters may differ by k = m * `error_rate` edits, at least 0 and few enough that pieces
keep `min_piece` characters. The item is cut into k + 1 pieces; k edits leave at least one of
them intact, so every occurrence within k edits holds an exact piece at its place, give or
take k characters. One automaton finds the pieces of all items in one pass over a text;
places are verified by Myers' bit-parallel distance in the text around them.

The benchmark goes to the tasks in blocks of about `block_chars` characters, so what is
broadcast is bounded whatever the benchmark's size; all texts of one item_id are in the same
block, which is larger where they are. Documents never shuffle.

Defined results: null or empty texts and items match nothing. Items without words are left
out. Rows with equal item_id are separate items and report their best distance. Repeated
documents are reported alike, once per row."""

from __future__ import annotations

from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomgraph.llm.textops import chunks, field_as_text


def normal(text: str | None) -> str:
    return b" ".join((text or "").encode().lower().split()).decode()


def budget(m: int, error_rate: float, min_piece: int) -> int:
    return max(0, min(int(m * error_rate), m // min_piece - 1))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length with their offsets."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def pattern_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers_best(masks: dict[str, int], m: int, text: str, most: int) -> int:
    """Least edit distance of the pattern to any piece of the text; most + 1 if above `most`."""
    ones, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = ones, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & ones, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph = ph << 1 & ones  # the match may start anywhere, so row 0 stays 0
        pv, mv = (mh << 1 & ones) | ~(xv | ph) & ones, ph & xv
    return min(best, most + 1)


def at_word_edges(text: str, start: int, end: int) -> bool:
    """Does text[start:end] neither begin nor end inside a word?"""
    before = start and text[start - 1].isalnum() and text[start].isalnum()
    after = end < len(text) and text[end].isalnum() and text[end - 1].isalnum()
    return not before and not after


class Matcher:
    """Finds a block of items in texts."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float, min_piece: int):
        self.items = []
        where: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            if not text:
                continue
            k = budget(len(text), error_rate, min_piece)
            for at, piece in pieces(text, k):
                where.setdefault(piece, []).append((len(self.items), at))
            self.items.append((item_id, text, k, pattern_masks(text)))
        self.automaton = ahocorasick.Automaton()
        for piece, at in where.items():
            self.automaton.add_word(piece, (len(piece), at))
        if where:
            self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, int]:
        """item_id -> least distance, for items within their budget."""
        found: dict[int, int] = {}
        if not text or not self.items:
            return found
        places: dict[int, set[int]] = {}
        for end, (size, at) in self.automaton.iter(text):
            for n, offset in at:
                places.setdefault(n, set()).add(end + 1 - size - offset)
        for n, starts in places.items():
            item_id, item, k, masks = self.items[n]
            if not k:  # too short for errors: the place is the whole item, as words of its own
                if any(at_word_edges(text, s, s + len(item)) for s in starts):
                    found[item_id] = 0
                continue
            best = 0 if item in text else k + 1
            last = None
            for s in sorted(starts):
                if not best:
                    break
                if last is not None and s - last <= k:  # the window of the last place covers this one
                    continue
                last = s
                best = min(best, myers_best(masks, len(item), text[max(0, s - k): s + len(item) + 3 * k], k))
            if best <= k and best < found.get(item_id, k + 1):
                found[item_id] = best
        return found


def find_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               error_rate: float = 0.05, min_piece: int = 12, block_chars: int = 8 << 20) -> DataFrame:
    """doc_id, item_id, distance of every item that occurs in a document within its budget."""
    return _matched(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")),
                    benchmark, error_rate, min_piece, block_chars)


def _blocks(benchmark: DataFrame, block_chars: int):
    """Items of the benchmark, block by block."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_chars) * 2 if total > block_chars else 1
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) if n > 1 else items
        yield [(r["item_id"], normal(r["text"])) for r in rows.distinct().collect()]


def _matched(rows: DataFrame, benchmark: DataFrame, error_rate: float, min_piece: int, block_chars: int) -> DataFrame:
    sc = rows.sparkSession.sparkContext

    def scan(shared):
        def run(batches):
            matcher = Matcher(shared.value, error_rate, min_piece)
            for whole in batches:
                for b in chunks(whole, "text"):
                    ids, items, dist = [], [], []
                    for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                        for item_id, d in matcher.find(normal(t)).items():
                            ids.append(i), items.append(item_id), dist.append(d)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, pa.int64()), pa.array(items, pa.int64()), pa.array(dist, pa.int32())],
                        ["doc_id", "item_id", "distance"])
        return run

    parts = [rows.mapInArrow(scan(sc.broadcast(block)), "doc_id bigint, item_id bigint, distance int")
             for block in _blocks(benchmark, block_chars)]
    return reduce(DataFrame.unionByName, parts)


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", error_rate: float = 0.05,
                    min_piece: int = 12, block_chars: int = 8 << 20) -> DataFrame:
    """The rows of `docs` that hold no item within its budget."""
    sc = docs.sparkSession.sparkContext
    names = docs.columns

    def scan(shared):
        def run(batches):
            matcher = Matcher(shared.value, error_rate, min_piece)
            for whole in batches:
                for b in chunks(field_as_text(whole, "row", text_col, "t"), "t"):
                    good = [not matcher.find(normal(t)) for t in b.column("t").to_pylist()]
                    yield b.select(["row"]).filter(pa.array(good, pa.bool_()))
        return run

    for block in _blocks(benchmark, block_chars):
        packed = docs.select(F.struct("*").alias("row"))
        docs = packed.mapInArrow(scan(sc.broadcast(block)), packed.schema).select("row.*").toDF(*names)
    return docs
