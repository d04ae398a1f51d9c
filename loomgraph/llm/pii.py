"""Personal data: exact patterns, and a semi-Markov conditional random field that adds spans.

The patterns give the base spans, leftmost and non-overlapping for each kind. The field sees
islands: runs of neighbouring words (maximal runs without white space) that hold a digit or an @. A segment
of up to MAX_WORDS words, without the punctuation around it, is a candidate for each kind and
is scored by features of the whole span: its digits, separators, groups, check digit,
shape and the word before. Dynamic programming over segments bounded by MAX_WORDS chooses
boundaries and kinds together; words outside are segments of one word.

The field is fitted by maximum likelihood (forward-backward over segments) on islands of a
bounded sample, `fit_docs` documents in the order of a hash, whole texts, whose truth is the base spans. Its
spans are added where they overlap no base span; base spans are never changed. For fitting,
islands are cut into runs of `FIT_WORDS` words; of those with a candidate at most `max_islands` are
taken, drawn by a hash and evenly over the documents.

Defined results: null and empty texts have no spans. Repeated rows get equal spans. Without
documents to fit on only the base spans remain. Columns other than id and text are not read."""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomgraph.llm.textops import bounded_sample, chunks

KINDS = ("email", "ip", "card", "phone")
MAX_WORDS, FIT_WORDS = 6, 40
SPACE = " \t\n\x0b\x0c\r"
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP_RUN = re.compile(r"[0-9.]+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """The local part is what its characters reach to the left of an @, up to the last match."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append(("email", start, end))
        else:
            end = max(end, at + 1)
        at = text.find("@", end)
    return out


def ips(text: str) -> list[Span]:
    out = []
    for run in IP_RUN.finditer(text):
        if run.group().count(".") >= 3:
            for m in IP.finditer(text, run.start(), run.end()):
                if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                    out.append(("ip", m.start(), m.end()))
    return out


def cards(text: str) -> list[Span]:
    out = []
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    return out


def phones(text: str) -> list[Span]:
    return [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15]


def base_spans(text: str | None) -> list[Span]:
    """By kind as listed, then by start."""
    if not text or not TRIGGER.search(text):
        return []
    return emails(text) + ips(text) + cards(text) + phones(text)


def islands(text: str) -> list[list[tuple[int, int]]]:
    """Runs of neighbouring words with a digit or @."""
    out: list[list[tuple[int, int]]] = []
    last_end, at = -1, 0
    for m in TRIGGER.finditer(text):
        if m.start() < at:
            continue
        start = m.start()
        while start > max(0, last_end) and text[start - 1] not in SPACE:
            start -= 1
        at = WORD.match(text, m.start()).end()
        if out and last_end >= 0 and not text[last_end:start].strip(SPACE):
            out[-1].append((start, at))
        else:
            out.append([(start, at)])
        last_end = at
    return out


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while end > start and text[end - 1] in ".,;:!?\"'<>[]{}|":
        end -= 1
    while end > start and text[start] in ".,;:!?\"'<>[]{}|":
        start += 1
    return start, end


def span_features(text: str, start: int, end: int, words: int) -> list[str]:
    """Names of the features that hold for a whole span."""
    s = text[start:end]
    digits = NOT_DIGIT.sub("", s)
    letters = sum(map(str.isalpha, s))
    parts = s.split(".")
    before = text[max(0, start - 16): start].split()
    local, at, domain = s.partition("@")
    out = [
        "bias", f"words={words}", f"digits={min(len(digits), 20)}", f"ats={min(s.count('@'), 2)}", f"dots={min(s.count('.'), 5)}",
        f"letters={min(letters.bit_length(), 4)}", f"plus={s[:1] == '+'}", f"paren={'(' in s and ')' in s}",
        f"seps={'-' in s}{' ' in s}", f"first={_shape(s[:1])}", f"last={_shape(s[-1:])}",
    ]
    if at:
        out.append(f"domain={bool(local) and '.' in domain.strip('.') and '@' not in domain}")
    if not letters and 13 <= len(digits) <= 19:
        out.append(f"luhn={luhn(digits)}")
    if len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts):
        out.append(f"octets={all(len(p.lstrip('0')) <= 3 and int(p) <= 255 for p in parts)}")
    if before and before[-1].strip(":.,").isalpha() and len(before[-1]) < 12:
        out.append(f"before={before[-1].strip(':.,').lower()}" if before[-1].endswith(":") else "before=word")
    return out


def _shape(c: str) -> str:
    return "d" if "0" <= c <= "9" else "a" if c.isalpha() else c


class SegmentField:
    """weights[(kind, feature)]; the outside label is the zero of every score."""

    def __init__(self, weights: dict[tuple[str, str], float] | None = None):
        self.weights = weights or {}

    def candidates(self, text: str, island: list[tuple[int, int]]):
        """(i, j, start, end, feature names) of each segment of words i..j-1 that can be an entity:
        it holds an @, or no letter and either seven digits or three dots."""
        words = [text[s:e] for s, e in island]
        plain = [not any(map(str.isalpha, w)) for w in words]
        digits = [len(NOT_DIGIT.sub("", w)) for w in words]
        for i in range(len(island)):
            at, bare, figures, dots = False, True, 0, 0
            for j in range(i + 1, min(len(island), i + MAX_WORDS) + 1):
                at, bare = at or "@" in words[j - 1], bare and plain[j - 1]
                figures, dots = figures + digits[j - 1], dots + words[j - 1].count(".")
                if not at and not (bare and (figures >= 7 or dots >= 3)):
                    continue
                start, end = trimmed(text, island[i][0], island[j - 1][1])
                if end > start:
                    yield i, j, start, end, span_features(text, start, end, j - i)

    def decode(self, text: str, island: list[tuple[int, int]]) -> list[Span]:
        n = len(island)
        by_end: list[list] = [[] for _ in range(n + 1)]
        for i, j, start, end, names in self.candidates(text, island):
            for kind in KINDS:
                by_end[j].append((i, kind, start, end, sum(self.weights.get((kind, f), 0.0) for f in names)))
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for seg in by_end[j]:
                if best[seg[0]] + seg[4] > best[j] + 1e-9:
                    best[j], back[j] = best[seg[0]] + seg[4], seg
        out, j = [], n
        while j > 0:
            seg = back[j]
            if seg is None:
                j -= 1
            else:
                out.append((seg[1], seg[2], seg[3]))
                j = seg[0]
        return out

    def spans(self, text: str | None, base: list[Span]) -> list[Span]:
        """Spans of the field that overlap no base span."""
        if not text or not self.weights:
            return []
        taken = sorted((s, e) for _, s, e in base)
        added = [x for island in islands(text) for x in self.decode(text, island)]
        return [x for x in added if not any(s < x[2] and x[1] < e for s, e in taken)] if taken else added


def fit_field(texts: list[str], steps: int = 60, rate: float = 0.3, decay: float = 2e-4, max_islands: int = 4000) -> SegmentField:
    """Maximum likelihood by Adam; the truth of an island is its base spans that are segments."""
    field = SegmentField()
    names: dict[tuple[str, str], int] = {}
    graphs = []
    for text, runs in zip(texts, drawn_islands(texts, max_islands)):
        truth = {(s, e): k for k, s, e in base_spans(text)} if runs else {}
        for island in runs:
            segs, gold, used = [], [], -1
            for i, j, start, end, feats in field.candidates(text, island):
                for kind in KINDS:
                    ids = np.array([names.setdefault((kind, f), len(names)) for f in feats])
                    segs.append((i, j, ids))
                    if truth.get((start, end)) == kind and i >= used:
                        gold.append(len(segs) - 1)
                        used = j
            graphs.append((len(island), segs, gold))
    if not graphs:
        return field
    w = np.zeros(len(names))
    m, v = np.zeros_like(w), np.zeros_like(w)
    flat = [(np.concatenate([s[2] for s in segs]), np.repeat(np.arange(len(segs)), [len(s[2]) for s in segs]), n, segs, gold)
            for n, segs, gold in graphs]
    for k in range(1, steps + 1):
        grad = -decay * w * len(flat)
        for ids, owner, n, segs, gold in flat:
            score = np.bincount(owner, w[ids], len(segs))
            expected = _expected(n, segs, score)
            expected[gold] -= 1
            np.subtract.at(grad, ids, expected[owner])
        grad /= len(flat)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return SegmentField({name: float(w[i]) for name, i in names.items()})


def drawn_islands(texts: list[str], most: int) -> list[list[list[tuple[int, int]]]]:
    """Islands with candidates, cut for fitting, of each text; at most `most` of them. Beyond, each text gives
    its first in the order of a hash before any gives its second, and so on."""
    field, ranked = SegmentField(), []
    for d, text in enumerate(texts):
        runs = [island[k: k + FIT_WORDS] for island in islands(text) for k in range(0, len(island), FIT_WORDS)]
        mine = heapq.nsmallest(most, ((zlib.crc32(text[r[0][0]: r[-1][1]].encode()), r[0][0], r) for r in runs
                                      if next(field.candidates(text, r), None)))
        ranked += [(rank, h, d, at, r) for rank, (h, at, r) in enumerate(mine)]
        if len(ranked) > 4 * most:
            ranked = heapq.nsmallest(most, ranked)
    out: list[list] = [[] for _ in texts]
    for _, _, d, _, r in heapq.nsmallest(most, ranked):
        out[d].append(r)
    return [sorted(runs) for runs in out]


def _expected(n: int, segs: list, score: np.ndarray) -> np.ndarray:
    """Posterior of each segment by forward-backward over positions."""
    alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    alpha[0] = beta[n] = 0.0
    ends: list[list[int]] = [[] for _ in range(n + 1)]
    starts: list[list[int]] = [[] for _ in range(n + 1)]
    for s, (i, j, _) in enumerate(segs):
        ends[j].append(s), starts[i].append(s)
    for j in range(1, n + 1):
        terms = [alpha[j - 1], *(alpha[segs[s][0]] + score[s] for s in ends[j])]
        alpha[j] = np.logaddexp.reduce(terms)
    for i in range(n - 1, -1, -1):
        terms = [beta[i + 1], *(beta[segs[s][1]] + score[s] for s in starts[i])]
        beta[i] = np.logaddexp.reduce(terms)
    i, j = np.array([s[0] for s in segs]), np.array([s[1] for s in segs])
    return np.exp(alpha[i] + score + beta[j] - alpha[n])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_docs: int = 600,
             max_islands: int = 4000) -> DataFrame:
    """doc_id, base (spans of the patterns, joined), spans (all spans, joined) and the number
    of base spans of each kind, for each row."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sample = bounded_sample(rows.filter(F.col("text").rlike("[0-9@]")), fit_docs, "doc_id", "text").select("text").collect()
    shared = docs.sparkSession.sparkContext.broadcast(fit_field([r["text"] for r in sample], max_islands=max_islands))

    def run(batches):
        field = shared.value
        for whole in batches:
            for b in chunks(whole, "text"):
                base, every, counts = [], [], []
                for t in b.column("text").to_pylist():
                    found = base_spans(t)
                    base.append(joined(found))
                    every.append(joined(found + field.spans(t, found)) if t and TRIGGER.search(t) else "")
                    counts.append([sum(k == kind for k, _, _ in found) for kind in KINDS])
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(len(KINDS))),
                     pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base]), pa.array(base, pa.string()), pa.array(every, pa.string())],
                    ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "spans"])

    kinds = ", ".join(f"n_{k} bigint" for k in KINDS)
    return rows.mapInArrow(run, f"doc_id bigint, {kinds}, base_sha256 string, base string, spans string")
