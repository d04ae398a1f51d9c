"""Quality rules: isolation forests on rule statistics.

Every text is measured once: words, their code points, symbols, repeated lines, repeated three-word
windows. The base rules reject short texts and those mostly made of repeated windows. For the rest,
each group of statistics (form of the words, repetition, length) has an isolation forest: trees of
random splits on small draws of documents; a document that few splits set apart has a short mean path
and a high anomaly score. A forest alone knows nothing of quality. Its threshold is calibrated from
labelled rows: of all scores that would reject at most `most_lost` of the label-1 rows, and at least as
many label-0 as label-1 rows, the one with the best difference of the two shares. A forest without
such a score rejects nothing.

Bounds. A tree sees `tree_rows` documents by design of the method, few enough that junk is no cluster
of its own in most trees, drawn by hash from all that pass the base rules: `trees * tree_rows` rows reach the driver. Statistics, scores and the histograms of
labelled scores (`STEPS` bins) cover all rows, and no text leaves its task.

Defined results: null and empty texts have no words, fail the base rules and are not kept. Without
labels, or with one kind of them, the verdict is that of the base rules. Where an id has several labels
the smallest counts; a null id has none. Repeated rows get equal results. Lines are compared as they are,
words unchanged. Columns other than id and text, and id and quality of the labels, are not read."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from loomgraph.llm.exact_dedup import CONTINUATION
from loomgraph.llm.textops import bounded_sample, chunks
from loomgraph.session import Scratch

SYMBOLS = b"#*$%&|<>"
STEPS = 4096
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
GROUPS = ("form", "repetition", "length")


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """How many words lie in windows of `size` words that occur twice or more in the text."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    code = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    window = code[:n]
    for k in range(1, size):  # numbers stay below the square of the text's length
        _, window = np.unique(window * len(number) + code[k: k + n], return_inverse=True)
    starts = np.flatnonzero(np.bincount(window)[window] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return int((np.cumsum(edge) > 0).sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    """STATS of one text, from its UTF-8 bytes."""
    t = text or b""
    words = t.split()  # splits at the same six bytes as the definition of a word
    lines = [line for line in t.split(b"\n") if line.strip()]
    continued = len(t) - len(t.translate(None, CONTINUATION))
    return (len(words), sum(map(len, words)) - continued, len(t) - len(t.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words), len(lines))


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and STATS of every row."""

    def run(batches):
        for whole in batches:
            for b in chunks(whole, "text"):
                got = [measure(t) for t in b.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), *(pa.array(c, pa.int64()) for c in zip(*got))], ["doc_id", *STATS])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, " + ", ".join(f"{c} bigint" for c in STATS))


def group_features(stats: np.ndarray) -> dict[str, np.ndarray]:
    """Columns of each group from rows of STATS."""
    n, chars, symbols, dup, repeat, lines = stats.T.astype(np.float64)
    some, some_lines = np.maximum(n, 1), np.maximum(lines, 1)
    return {"form": np.stack((chars / some, symbols / some), axis=1),
            "repetition": np.stack((dup / some_lines, repeat / some), axis=1),
            "length": np.stack((np.log1p(n), np.log1p(n / some_lines)), axis=1)}


# --- forest -------------------------------------------------------------------------------


def expected_path(n: int) -> float:
    """Mean path of an unsuccessful search in a binary search tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class Tree:
    """Random splits: a column that still varies and a value between its ends, until the rows
    are one or `depth` is reached. A leaf stores its depth plus the path its rows would still need."""

    def __init__(self, x: np.ndarray, rng: np.random.Generator, depth: int):
        self.column, self.cut, self.left, self.right, self.path = [], [], [], [], []
        self._grow(x, rng, 0, depth)
        self.column, self.left, self.right = (np.array(v, np.int32) for v in (self.column, self.left, self.right))
        self.cut, self.path = np.array(self.cut), np.array(self.path)

    def _grow(self, x: np.ndarray, rng: np.random.Generator, at: int, depth: int) -> int:
        k = len(self.path)
        for part, value in ((self.column, -1), (self.cut, 0.0), (self.left, k), (self.right, k), (self.path, at + expected_path(len(x)))):
            part.append(value)
        low, high = x.min(axis=0), x.max(axis=0)
        free = np.flatnonzero(high > low)
        if at < depth and len(free):
            j = int(rng.choice(free))
            c = float(rng.uniform(low[j], high[j]))
            less = x[:, j] < c
            if 0 < less.sum() < len(x):
                self.column[k], self.cut[k] = j, c
                self.left[k] = self._grow(x[less], rng, at + 1, depth)
                self.right[k] = self._grow(x[~less], rng, at + 1, depth)
        return k

    def paths(self, x: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), np.int32), np.arange(len(x))
        while True:
            column = self.column[at]
            if (column < 0).all():
                return self.path[at]
            at = np.where(column < 0, at, np.where(x[rows, column] < self.cut[at], self.left[at], self.right[at]))


class Forest:
    def __init__(self, x: np.ndarray, trees: int, tree_rows: int, seed: int):
        rng = np.random.default_rng(seed)
        size = min(len(x), tree_rows)
        depth = math.ceil(math.log2(max(size, 2)))
        self.trees = [Tree(x[rng.choice(len(x), size, replace=False)], rng, depth) for _ in range(trees)]
        self.usual = max(expected_path(size), 1.0)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly of each row, between 0 and 1; about 0.5 is usual."""
        mean = sum(t.paths(x) for t in self.trees) / len(self.trees)
        return 2.0 ** (-mean / self.usual)


def fit_forests(sample: np.ndarray, trees: int, tree_rows: int) -> dict[str, Forest]:
    return {g: Forest(x, trees, tree_rows, seed) for seed, (g, x) in enumerate(group_features(sample).items())}


def score_groups(stats: DataFrame, forests: dict[str, Forest]) -> DataFrame:
    """Adds the anomaly score of every group; 0 for rows that fail the base rules, as they need none."""
    shared = stats.sparkSession.sparkContext.broadcast(forests)  # bounded by trees and tree_rows

    def run(batches):
        for b in batches:
            x = np.stack([b.column(c).to_numpy() for c in STATS], axis=1)
            open_rows = ~b.column("base_failed").to_numpy(zero_copy_only=False)
            out = np.zeros((len(GROUPS), len(x)))
            if open_rows.any():
                features = group_features(x[open_rows])
                for i, g in enumerate(GROUPS):
                    out[i, open_rows] = shared.value[g].scores(features[g])
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, out)], [*b.schema.names, *GROUPS])

    return stats.mapInArrow(run, StructType([*stats.schema, *(StructField(g, DoubleType()) for g in GROUPS)]))


def best_step(good: np.ndarray, bad: np.ndarray, most_lost: float) -> int | None:
    """First bin to reject, from the labelled rows per bin."""
    if not good.sum() or not bad.sum():
        return None
    lost, caught = (np.cumsum(h[::-1])[::-1] for h in (good, bad))  # rejected from this bin on
    gain = caught / bad.sum() - lost / good.sum()
    gain[(lost > most_lost * good.sum()) | (caught < lost) | (caught == 0)] = -1
    k = len(gain) - 1 - int(np.argmax(gain[::-1]))  # of equal ones the highest
    return k if gain[k] > 0 else None


def calibrate(scored: DataFrame, labels: DataFrame, most_lost: float) -> dict[str, int | None]:
    """First rejected bin of every group, from the histograms of all labelled rows."""
    kinds = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    kinds = kinds.filter("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = scored.filter("not base_failed").join(kinds, "doc_id")
    bins = F.explode(F.array(*[F.struct(F.lit(g).alias("g"), step_of(g).alias("bin")) for g in GROUPS]))
    counts = rows.select("quality", bins.alias("b")).groupBy("b.g", "b.bin", "quality").count()
    good, bad = ({g: np.zeros(STEPS + 1, np.int64) for g in GROUPS} for _ in range(2))
    for r in counts.collect():  # at most 2 * STEPS rows per group
        (good if r["quality"] else bad)[r["g"]][r["bin"]] += r["count"]
    return {g: best_step(good[g], bad[g], most_lost) for g in GROUPS}


def step_of(group: str):
    return F.floor(F.col(group) * STEPS).cast("int")


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50,
                  most_repeated: int = 50, trees: int = 200, tree_rows: int = 64, most_lost: float = 0.01) -> DataFrame:
    """doc_id, STATS, base_failed, the anomaly score of each group and kept, one row per input row."""
    scratch = Scratch(docs.sparkSession)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    stats = scratch.write("stats", rule_statistics(docs, id_col, text_col).withColumn("base_failed", failed))
    drawn = bounded_sample(stats.filter("not base_failed"), trees * tree_rows, "doc_id", *STATS).select(*STATS).collect()
    if not drawn:
        return stats.select("*", *[F.lit(0.0).alias(g) for g in GROUPS], F.lit(False).alias("kept"))
    forests = fit_forests(np.array([tuple(r) for r in drawn], np.int64), trees, tree_rows)
    scored = scratch.write("scored", score_groups(stats, forests))
    scratch.remove("stats")
    first = calibrate(scored, labels, most_lost)
    odd = F.lit(False)
    for g in GROUPS:
        if first[g] is not None:
            odd = odd | (step_of(g) >= first[g])
    return scored.withColumn("kept", ~F.col("base_failed") & ~odd)
