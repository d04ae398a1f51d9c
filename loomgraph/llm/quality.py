"""Document quality from a linear-chain conditional random field over lines.

Every line with a word is labelled good or bad. Its features are shares of byte classes,
word statistics, repetition, and the same figures of the line before and after. The field is
fitted on documents with a quality label, whose lines take the label. Forward-backward gives
each line's marginal; their mean weighted by line length, through a logistic calibration,
is the document's score.

Fitting is bounded: `fit_docs` labelled documents in the order of a hash, whole texts; for
fitting, chains are cut into runs of `fit_run` lines. Scoring reads whole texts and whole chains.

Defined results: null, empty and blank texts have no line and get the share of label 1 among
the fitted documents. With labels of one kind or none every score is (ones + 1) / (rows + 2).
Where a doc_id has several labels the smallest counts. Repeated rows get equal
scores. Columns other than id and text, and doc_id and quality of the labels, are not read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomgraph.llm.textops import chunks, flat_bytes, mix, word_bounds, word_hashes

UPPER, LETTER, DIGIT, SYMBOL, PIPE, BANG, WIDE = (np.zeros(256, bool) for _ in range(7))
UPPER[65:91] = True
LETTER[65:91] = LETTER[97:123] = LETTER[192:] = True
DIGIT[48:58] = True
SYMBOL[list(b"#$%&*+/<=>@\\^_`{|}~[]")] = True
PIPE[ord("|")] = True
BANG[ord("!")] = True
WIDE[128:] = True
STOP = np.zeros(256, bool)
STOP[list(b".!?")] = True
NEIGHBOUR = slice(2, 9)
N_OWN = 14
N_FEATURES = N_OWN + 2 * (NEIGHBOUR.stop - NEIGHBOUR.start) + 2


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and byte length of each line with a word, and the number of such lines by row."""
    raw, offs = flat_bytes(column)
    n = len(raw)
    feed = np.flatnonzero(raw == 10)
    edges = np.union1d(offs, np.concatenate((feed, feed + 1)))
    starts, ends, _ = word_bounds(raw, offs)
    # words between two edges; pieces without a word are blank or the line feed itself
    first = np.searchsorted(starts, edges[:-1]) if len(edges) > 1 else np.zeros(0, np.int64)
    last = np.searchsorted(starts, edges[1:]) if len(edges) > 1 else first
    full = last > first
    first, last = first[full], last[full]
    lo, hi = starts[first] if len(first) else first, ends[last - 1] if len(first) else first
    row = np.searchsorted(offs, lo, "right") - 1
    counts = np.bincount(row, minlength=len(offs) - 1).astype(np.int64)
    if not len(lo):
        return np.zeros((0, N_FEATURES), np.float32), np.zeros(0), counts

    def count(flag: np.ndarray) -> np.ndarray:
        sums = np.zeros(n + 1, np.int64)
        np.cumsum(flag[raw], out=sums[1:])
        return (sums[hi] - sums[lo]).astype(np.float64)

    size = (hi - lo).astype(np.float64)
    words = (last - first).astype(np.float64)
    solid = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=solid[1:])
    solid = (solid[last] - solid[first]).astype(np.float64)
    h = word_hashes(raw, starts, ends)
    same = np.zeros(len(h) + 1, np.int64)
    np.cumsum(np.concatenate(([False], h[1:] == h[:-1])), out=same[1:])
    same = (same[last] - same[np.minimum(first + 1, last)]).astype(np.float64)
    key = mix(np.add.reduceat(h * mix(np.arange(len(h), dtype=np.uint64) - np.repeat(first, last - first).astype(np.uint64)), first) + row.astype(np.uint64))
    _, where, times = np.unique(key, return_inverse=True, return_counts=True)
    letters = count(LETTER)
    own = np.stack([
        np.ones(len(lo)), np.log1p(size) / 6, count(UPPER) / (letters + 1), count(SYMBOL) / solid, count(DIGIT) / solid,
        count(PIPE) / words, count(BANG) / words, same / words, times[where] > 1, solid / words / 10,
        count(WIDE) / solid, STOP[raw[hi - 1]], np.log1p(words) / 5, count(STOP) / words], axis=1)
    x = np.zeros((len(lo), N_FEATURES), np.float32)
    x[:, :N_OWN] = own
    k = NEIGHBOUR.stop - NEIGHBOUR.start
    inner = row[1:] == row[:-1]
    x[1:, N_OWN: N_OWN + k] = own[:-1, NEIGHBOUR] * inner[:, None]
    x[:-1, N_OWN + k: N_OWN + 2 * k] = own[1:, NEIGHBOUR] * inner[:, None]
    x[1:, -2], x[:-1, -1] = inner, inner
    return x, size, counts


class Chain:
    """Two-label chains of given lengths, longest first, stepped together."""

    def __init__(self, counts: np.ndarray):
        counts = counts[counts > 0]
        starts = np.cumsum(counts) - counts
        order = np.argsort(-counts, kind="stable")
        self.starts, self.counts = starts[order], counts[order]
        self.n, self.longest = int(counts.sum()), int(counts.max()) if len(counts) else 0
        # chains longer than t are the first active[t]
        self.active = np.searchsorted(-self.counts, -np.arange(self.longest), "left")

    def marginals(self, unary: np.ndarray, trans: np.ndarray, pairs: bool = False):
        """P(good) of each line; with `pairs` also the expected share of transitions at each
        line but the last, as [n, 2, 2]. `unary` is the score of good against bad."""
        a, b = np.zeros((self.n, 2)), np.zeros((self.n, 2))
        for t in range(self.longest):
            at = self.starts[: self.active[t]] + t
            if t:
                p = a[at - 1]
                a[at, 0] = np.logaddexp(p[:, 0] + trans[0, 0], p[:, 1] + trans[1, 0])
                a[at, 1] = np.logaddexp(p[:, 0] + trans[0, 1], p[:, 1] + trans[1, 1])
            a[at, 1] += unary[at]
        for t in range(self.longest - 2, -1, -1):
            at = self.starts[: self.active[t + 1]] + t
            q0, q1 = b[at + 1, 0], b[at + 1, 1] + unary[at + 1]
            b[at, 0] = np.logaddexp(trans[0, 0] + q0, trans[0, 1] + q1)
            b[at, 1] = np.logaddexp(trans[1, 0] + q0, trans[1, 1] + q1)
        d = (a + b)[:, 1] - (a + b)[:, 0]
        good = 1 / (1 + np.exp(-np.clip(d, -500, 500)))
        if not pairs:
            return good
        ends = np.zeros(self.n, bool)
        ends[self.starts + self.counts - 1] = True
        at = np.flatnonzero(~ends)
        u = np.stack([np.zeros(len(at)), unary[at + 1]], axis=1)
        log = a[at][:, :, None] + trans[None] + (u + b[at + 1])[:, None, :]
        log -= np.logaddexp(*(a + b)[at].T)[:, None, None]
        return good, at, np.exp(log)


class LineField:
    def __init__(self, weights: np.ndarray, trans: np.ndarray, scale: tuple[float, float], prior: float, constant: bool = False):
        self.weights, self.trans, self.scale, self.prior, self.constant = weights, trans, scale, prior, constant

    def means(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Length-weighted mean of the marginals of each row, and the rows that have lines."""
        x, size, counts = line_features(column)
        row = np.repeat(np.arange(len(counts)), counts)
        good = Chain(counts).marginals(x @ self.weights, self.trans) if len(x) else np.zeros(0)
        total = np.bincount(row, size, len(counts))
        mean = np.bincount(row, size * good, len(counts)) / np.maximum(total, 1)
        return mean, counts > 0

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.constant:
            return np.full(len(column), self.prior)
        mean, has = self.means(column)
        return np.where(has, 1 / (1 + np.exp(-(self.scale[0] * _logit(mean) + self.scale[1]))), self.prior)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_field(texts: list[str], labels: list[int], fit_run: int = 64, steps: int = 120, rate: float = 0.15, decay: float = 1e-3) -> LineField:
    """Maximum likelihood by Adam; every document weighs the same, whatever its length."""
    ones, n = sum(labels), len(labels)
    if not 0 < ones < n:
        return LineField(np.zeros(N_FEATURES), np.zeros((2, 2)), (1.0, 0.0), (ones + 1) / (n + 2), constant=True)
    column = pa.array(texts, pa.large_string())
    x, _, counts = line_features(column)
    x = x.astype(np.float64)
    y = np.repeat(np.asarray(labels, float), counts)
    weight = np.repeat(1 / np.maximum(counts, 1), counts) / n
    runs = np.array([min(fit_run, c - i) for c in counts for i in range(0, c, fit_run)], np.int64)
    chain = Chain(runs)
    w, trans = np.zeros(N_FEATURES), np.zeros((2, 2))
    m, v = np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4)
    for k in range(1, steps + 1):
        good, at, pair = chain.marginals(x @ w, trans, pairs=True)
        truth = np.zeros((len(at), 2, 2))
        truth[np.arange(len(at)), y[at].astype(int), y[at + 1].astype(int)] = 1
        grad = np.concatenate([x.T @ (weight * (y - good)) - decay * w, (weight[at, None, None] * (truth - pair)).sum(0).ravel() - decay * trans.ravel()])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w, trans = w + step[:N_FEATURES], trans + step[N_FEATURES:].reshape(2, 2)
    field = LineField(w, trans, (1.0, 0.0), ones / n)
    mean, has = field.means(column)
    field.scale = calibrate(_logit(mean[has]), np.asarray(labels, float)[has])
    return field


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the labels on one value, by Newton steps with a small ridge."""
    beta = np.array([0.5, 0.0])
    x = np.stack([z, np.ones(len(z))], axis=1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        beta = beta + np.linalg.solve(hess, x.T @ (y - p) - 1e-2 * beta)
    return float(beta[0]), float(beta[1])


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_docs: int = 3000) -> DataFrame:
    """doc_id and score of each row. `labels` holds doc_id and quality to learn from."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = (labels.filter("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("bigint").alias("label_id"))
             .agg(F.min("quality").cast("int").alias("quality"))
             .orderBy(F.xxhash64(F.lit(5), "label_id"), "label_id").limit(fit_docs))
    sample = (rows.join(F.broadcast(known), F.col("doc_id") == F.col("label_id"))  # at most fit_docs ids
              .orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id", F.xxhash64("text")).limit(fit_docs).select("text", "quality").collect())
    shared = docs.sparkSession.sparkContext.broadcast(fit_field([r["text"] for r in sample], [r["quality"] for r in sample]))

    def run(batches):
        for whole in batches:
            for b in chunks(whole, "text"):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(shared.value.scores(b.column("text")), pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id bigint, score double")
