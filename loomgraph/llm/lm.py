"""Language-model scoring with a gated recurrent network.

Tokens are the words, A-Z lower-cased, and one end after each document. Counts of all
training tokens are taken over the whole corpus. The network's outcomes grow with them: the end,
each word with a count of at least a `SHARE`-th of the root of the number of training tokens (and
the `LEAST_WORDS` most frequent in any case), each ending (last `ENDING` bytes) whose other words
have that count together, and outcome 0 for what remains. A word without its own outcome has its
share of the add-half counts of its ending; each ending, and outcome 0, keeps half a count for
unseen words. The output softmax is factored: group of classes, class of the outcome, then outcome within the class.
Its biases start at the corpus counts, so the fit begins at the unigram model.

The network is written in numpy and fitted by truncated backpropagation over windows of
tokens, the state carried from window to window. `fit_docs` training documents in the order
of a hash, whole texts, give the start on the driver. From it the tasks fit all training documents,
dealt to `rounds` rounds by a hash: in a round each task fits its documents, and the networks are averaged by
their tokens. Scoring is the whole document's log-likelihood: state is carried across all windows
of a document, however long. Documents are packed on lanes that step together.

Frequent words (`head_words`, a bound of the tasks' memory, also of the outcomes that are words) are
looked up in the tasks; all other words are joined with the whole table of counts, so no count is
approximate. Results depend a little on how the rows are partitioned, as the averages do.

Defined results: null and empty texts hold the end only. Without training documents the
score is the base score. Repeated rows get equal scores. A row with null id is a
training row. Columns other than id and text are not read."""

from __future__ import annotations

import copy
from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.llm.textops import bounded_sample, chunks
from loomgraph.session import materialize, stored

END = b"\n"  # no word holds a line feed
LANES = 256
SHARE, LEAST_WORDS, ENDING = 16, 2014, 3
BLOCK = 1 << 14  # parameters in a row of what the tasks send, and in a piece of an update
ROWS = 1 << 10  # states that meet the classes at once
FIT_TOKENS, SCORE_TOKENS = 350_000, 1_400_000  # that a task holds at once, or one text


def tokens(text: bytes | None) -> list[bytes]:
    out = (text or b"").lower().split()
    out.append(END)
    return out


def token_counts(texts: DataFrame, flush: int = 400_000) -> DataFrame:
    """word, n over all texts; combined in the tasks before the shuffle."""

    def send(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches):
        counts: Counter = Counter()
        for whole in batches:
            for b in chunks(whole, "text"):
                for t in b.column("text").cast(pa.binary()).to_pylist():
                    counts.update(tokens(t))
                if len(counts) > flush:
                    yield send(counts)
                    counts = Counter()
        yield send(counts)

    return texts.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The words of the largest counts, frequent first, at most `most` of them and none of a
    class of counts that does not fit whole. The classes, sixteenths of a power of two, are
    counted first, so that no task sends more than its share."""
    step = F.floor(F.log2("n") * 16)
    sizes = counts.groupBy(step.alias("step")).count().collect()  # at most 16 * 64 rows
    least, total = None, 0
    for r in sorted(sizes, key=lambda r: -r["step"]):
        total += r["count"]
        if total > most:
            break
        least = r["step"]
    if least is None:
        return []
    found = [(bytes(r["word"]), r["n"]) for r in counts.filter(step >= least).collect()]
    return sorted(found, key=lambda x: (-x[1], x[0]))


def class_cuts(p: np.ndarray, each: float = 0.3) -> np.ndarray:
    """Bounds of classes of outcomes, the first alone, so that a token meets few of them: the classes, and
    the outcomes of its class. No class has more than a bound of share times outcomes, so frequent
    words stand in small classes; the best of some bounds is taken, where a class costs `each` outcomes."""
    total, n, best = np.concatenate(([0.0], np.cumsum(p))), len(p), None
    for bound in 2.0 ** np.arange(-6, 6, 0.5):
        cuts = [0, 1] if n > 1 else [0]
        while cuts[-1] < n:
            a, lo, hi = cuts[-1], cuts[-1] + 1, n
            while lo < hi:  # the product grows with the end
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if (total[mid] - total[a]) * (mid - a) <= bound else (lo, mid - 1)
            cuts.append(lo)
        at = np.array(cuts)
        cost = each * len(at) + (np.diff(total[at]) * np.diff(at)).sum()
        if best is None or cost < best[0]:
            best = cost, at
    return best[1]


class Recurrent:
    """One gated recurrent layer with a class-factored softmax.

    Outcome 0 is "another word", a class by itself; outcomes 1.. are words by falling count in the
    classes of `class_cuts`, or of `width` words each; classes stand in groups alike. Of the three parts of "x", "u" and "b" the
    first two are the gates."""

    def __init__(self, masses: np.ndarray, hidden: int = 32, width: int | None = None, seed: int = 1):
        rng = np.random.default_rng(seed)
        n, f = len(masses), np.float32
        p = masses / masses.sum()
        self.hidden = hidden
        self.cuts = class_cuts(p) if width is None else np.array([0, *range(1, n, width), n])
        self.cls = np.repeat(np.arange(len(self.cuts) - 1), np.diff(self.cuts))
        share = np.add.reduceat(p, self.cuts[:-1])
        self.tops = class_cuts(share, 0.8)
        self.top = np.repeat(np.arange(len(self.tops) - 1), np.diff(self.tops))
        most = np.add.reduceat(share, self.tops[:-1])
        with np.errstate(divide="ignore"):
            word_bias = np.maximum(np.log(p / np.maximum(share, 1e-300)[self.cls]), -1e4)
            class_bias = np.maximum(np.log(share / np.maximum(most, 1e-300)[self.top]), -1e4)
            top_bias = np.maximum(np.log(most), -1e4)
        self.p = {
            "x": (rng.standard_normal((3, n, hidden)) * 0.1).astype(f),
            "u": (rng.standard_normal((3, hidden, hidden)) / np.sqrt(hidden)).astype(f),
            "b": np.repeat(np.array([[0], [1], [0]], f), hidden, axis=1),
            "sw": np.zeros((len(most), hidden), f), "sb": top_bias.astype(f),
            "cw": np.zeros((len(share), hidden), f), "cb": class_bias.astype(f),
            "ww": np.zeros((n, hidden), f), "wb": word_bias.astype(f),
        }
        self.dx = None

    def __getstate__(self):
        return self.__dict__ | {"dx": None}

    def cell(self, gx: np.ndarray, h: np.ndarray, bias: np.ndarray, out: np.ndarray):
        """The next state into `out`, and the gates r and z, the new part and what r lets through.
        `gx` [3, lanes, hidden] is what the inputs add, `bias` has "b" for each lane."""
        gh = np.matmul(h, self.p["u"])
        gh += bias
        gates = gh[:2]
        gates += gx[:2]
        np.negative(gates, out=gates)
        with np.errstate(over="ignore"):
            np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        new = gates[0] * gh[2]
        new += gx[2]
        np.tanh(new, out=new)
        np.subtract(h, new, out=out)
        out *= gates[1]
        out += new
        return gates[0], gates[1], new, gh[2]

    def biases(self, lanes: int) -> np.ndarray:
        return np.repeat(self.p["b"][:, None], lanes, axis=1)

    def step(self, x: np.ndarray, h: np.ndarray):
        out = np.empty(h.shape, np.result_type(h, self.p["u"]))
        return out, self.cell(self.p["x"][:, x], h, self.biases(len(x)), out)

    def log_probs(self, hs: np.ndarray, y: np.ndarray, safe: bool = False) -> np.ndarray:
        """Natural log of P(outcome) for each row of states."""
        order, levels = self._levels(y)
        at, out, sums = hs[order], np.zeros(len(y), hs.dtype), np.ones((3, len(y)), hs.dtype)
        with np.errstate(all="ignore"):
            for level, (w, bias, ids, groups) in enumerate(levels):
                for a, b, rows in groups:
                    s = at[rows] @ w[a:b].T
                    s += bias[a:b]
                    own = taken(s, ids[rows] - a)
                    _, sums[level, rows], moved = exponentials(s, safe)
                    own -= moved
                    out[rows] += own
        if not safe and not in_range(sums):
            return self.log_probs(hs, y, True)
        out -= np.log(sums).sum(0)
        return out[turned(order)]

    def _levels(self, y: np.ndarray):
        """The order of the outcomes, and in it for groups of classes, classes and words: weights, biases, which
        of them each row is, and where those stand that a row may be, with the rows; a choice of one is left out."""
        order = np.argsort(y.astype(np.uint16) if len(self.cls) < 1 << 16 else y, kind="stable")
        ys, p = y[order], self.p
        cls = self.cls[ys]

        def met(ids: np.ndarray, cuts: np.ndarray) -> list:
            at = np.searchsorted(ids, cuts).tolist()
            return [(a, b, slice(i, j)) for a, b, i, j in zip(cuts.tolist(), cuts[1:].tolist(), at, at[1:]) if j > i and b - a > 1]

        all_tops = [(0, len(p["sb"]), slice(i, i + ROWS)) for i in range(0, len(y), ROWS)]
        return order, [(p["sw"], p["sb"], self.top[cls], all_tops), (p["cw"], p["cb"], cls, met(cls, self.tops)), (p["ww"], p["wb"], ys, met(ys, self.cuts))]

    def gradients(self, x, y, mask, reset, h):
        """Truncated backpropagation through one window [steps, lanes]; also the last state. Of the
        gradient of "x" only "rows" are not zero; it is valid until the next call."""
        p, k, f = self.p, self.hidden, self.p["u"].dtype
        (steps, lanes), n = x.shape, x.size
        gx = np.take(p["x"], x.ravel(), axis=1).reshape(3, steps, lanes, k)
        bias = self.biases(lanes)
        begins = [np.flatnonzero(r) for r in reset]
        # states before and after, z, r, and what the gradient of the state is multiplied by for n, z and r
        before, hs, zs, rs, to_n, to_z, to_r = (np.empty((steps, lanes, k), f) for _ in range(7))
        for t in range(steps):
            was = before[t]
            was[:] = h
            was[begins[t]] = 0
            h = hs[t]
            rs[t], z, new, gn = self.cell(gx[:, t], was, bias, h)
            r, zs[t] = rs[t], z
            left = 1 - z
            np.multiply(new, new, out=to_n[t])
            np.subtract(1, to_n[t], out=to_n[t])
            to_n[t] *= left
            np.subtract(was, new, out=to_z[t])
            to_z[t] *= z
            to_z[t] *= left
            np.subtract(1, r, out=left)
            np.multiply(gn, r, out=to_r[t])
            to_r[t] *= left
        g, dflat = self._outcome_gradients(hs.reshape(n, k), y.ravel(), mask.ravel() / f.type(max(1.0, float(mask.sum()))))
        dout = dflat.reshape(steps, lanes, k)
        back = np.ascontiguousarray(p["u"].transpose(0, 2, 1))
        dx, dgn, carry = gx, rs, np.zeros((lanes, k), f)  # both are used up step by step
        for t in range(steps - 1, -1, -1):
            d = dout[t]
            d += carry
            dr, dz, dn = dx[:, t]
            np.multiply(d, to_n[t], out=dn)
            np.multiply(d, to_z[t], out=dz)
            np.multiply(dn, to_r[t], out=dr)
            dgn[t] *= dn
            carry = d * zs[t]
            carry += dr @ back[0]
            carry += dz @ back[1]
            carry += dgn[t] @ back[2]
            carry[begins[t]] = 0
        flat, dx, dgn, ones = before.reshape(n, k), dx.reshape(3, n, k), dgn.reshape(n, k), np.ones(n, f)
        g["u"] = np.stack((flat.T @ dx[0], flat.T @ dx[1], flat.T @ dgn))
        g["b"] = np.stack((ones @ dx[0], ones @ dx[1], ones @ dgn))
        ids = x.ravel()
        order = np.argsort(ids.astype(np.uint16) if len(self.cls) < 1 << 16 else ids, kind="stable")
        ids = ids[order]
        at = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        if self.dx is None or self.dx[0].dtype != f:
            self.dx = np.zeros_like(p["x"]), ids[:0]
        full, old = self.dx
        full[:, old] = 0
        g["rows"] = ids[at]
        pair = np.result_type(f, np.complex64) if k % 2 == 0 else f  # two numbers are added at a time
        for i in range(3):
            full[i, g["rows"]] = np.add.reduceat(dx[i][order].view(pair), at, axis=0).view(f)
        self.dx = full, g["rows"]
        g["x"] = full
        return g, h

    def _outcome_gradients(self, flat: np.ndarray, y: np.ndarray, m: np.ndarray, safe: bool = False):
        """Gradients of the softmax parameters and of the states, each row weighed by `m`."""
        ones, g = np.ones(len(y), flat.dtype), {k: np.zeros_like(self.p[k]) for k in ("sw", "sb", "cw", "cb", "ww", "wb")}
        order, levels = self._levels(y)
        at, ms, ds, both = flat[order], m[order], np.zeros_like(flat), np.ones((3, len(y)), flat.dtype)
        with np.errstate(all="ignore"):
            for level, ((w, bias, ids, groups), kind) in enumerate(zip(levels, "scw")):
                dw, db = g[kind + "w"], g[kind + "b"]
                for a, b, rows in groups:
                    s = at[rows] @ w[a:b].T
                    s += bias[a:b]
                    s, sums, _ = exponentials(s, safe)
                    both[level, rows] = sums
                    s *= (ms[rows] / sums)[:, None]
                    take_off(s, ids[rows] - a, ms[rows])
                    dw[a:b] += s.T @ at[rows]
                    db[a:b] += ones[rows] @ s
                    ds[rows] += s @ w[a:b]
        if not safe and not in_range(both):
            return self._outcome_gradients(flat, y, m, True)
        return g, ds[turned(order)]


def turned(order: np.ndarray) -> np.ndarray:
    """Where each row went."""
    out = np.empty_like(order)
    out[order] = np.arange(len(order))
    return out


def exponentials(logits: np.ndarray, safe: bool):
    """Exponentials, their sums by row, and what was taken off the logits of each row before:
    if `safe`, the largest."""
    moved = 0
    if safe:
        moved = logits.max(1)
        logits -= moved[:, None]
    out = np.exp(logits, out=logits)
    return out, out @ np.ones(out.shape[1], out.dtype), moved


def in_range(sums: np.ndarray) -> bool:
    """Whether single precision held sums of exponentials well; false for what is no number."""
    return bool(sums.min() > 1e-25 and sums.max() < 1e30)


def taken(a: np.ndarray, cols: np.ndarray) -> np.ndarray:
    return a.ravel()[np.arange(0, a.size, a.shape[1]) + cols]


def take_off(a: np.ndarray, cols: np.ndarray, less: np.ndarray) -> None:
    a.reshape(-1)[np.arange(0, a.size, a.shape[1]) + cols] -= less


def pack(lengths: np.ndarray, lanes: int) -> list[list[int]]:
    """Documents on lanes of nearly equal total length, the fullest lane first."""
    import heapq

    heap = [(0, i) for i in range(min(lanes, max(1, len(lengths))))]
    out: list[list[int]] = [[] for _ in heap]
    for d in np.argsort(-lengths, kind="stable"):
        load, lane = heapq.heappop(heap)
        out[lane].append(int(d))
        heapq.heappush(heap, (load + int(lengths[d]), lane))
    return sorted(out, key=lambda lane: -int(lengths[lane].sum()))


def laid_out(seqs: list[np.ndarray], lanes: int, first: int | np.ndarray):
    """Inputs, targets, mask and resets as [steps, lanes], and the document of each place.
    `first` is what stands before the sequences, or before each of them."""
    lengths = np.array([len(s) for s in seqs])
    packed = pack(lengths, lanes)
    steps = max(int(lengths[lane].sum()) for lane in packed)
    y, doc = np.zeros((steps, len(packed)), np.int32), np.full((steps, len(packed)), -1, np.int32)
    reset = np.zeros((steps, len(packed)), np.float32)
    for j, lane in enumerate(packed):
        if not lane:
            continue
        joined = np.concatenate([seqs[d] for d in lane])
        y[: len(joined), j] = joined
        doc[: len(joined), j] = np.repeat(lane, lengths[lane])
        reset[np.cumsum([0, *lengths[lane][:-1]]), j] = 1
    x = np.vstack((np.zeros((1, len(packed)), np.int32), y[:-1]))  # all first places are resets
    x[reset > 0] = first if np.ndim(first) == 0 else first[doc[reset > 0]]
    return x, y, doc, reset


class Adam:
    """`m` and `v` are sums of past gradients and of their squares, which fade by 0.9 and 0.99. A row of "x"
    changes in windows that meet its input only: by that gradient alone, which is as far as the sum would carry it."""

    def __init__(self, net: Recurrent):
        self.net, self.done = net, 0
        self.m = {k: np.zeros_like(a) for k, a in net.p.items() if k != "x"}
        self.v = {k: np.zeros_like(a) for k, a in net.p.items()}
        self.met = np.zeros(len(net.cls), np.int64)

    def update(self, grads: dict[str, np.ndarray], rate: float) -> None:
        """One step, the gradient cut to length 1; `grads` is used up. Parameters are taken in pieces
        of a core's cache."""
        rows, p = grads.pop("rows"), self.net.p
        grads["x"] = np.take(grads["x"], rows, axis=1)
        norm = float(np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values())))
        self.done += 1
        cut, deviation = np.float32(1 / norm if norm > 1 else 1), np.sqrt(0.01 / (1 - 0.99**self.done))
        least, pace = np.float32(1e-7 / deviation), np.float32(rate * 0.1 / (1 - 0.9**self.done) / deviation)
        for k, whole in grads.items():
            if k == "x":
                continue
            for at in range(0, whole.size, BLOCK):
                g, m, v, own = (a.reshape(-1)[at: at + BLOCK] for a in (whole, self.m[k], self.v[k], p[k]))
                if norm > 1:
                    g *= cut
                m *= np.float32(0.9)
                m += g
                g *= g
                v *= np.float32(0.99)
                v += g
                np.sqrt(v, out=g)
                g += least
                np.divide(m, g, out=g)
                g *= pace
                own -= g
        faded = (0.99 ** (self.done - self.met[rows])).astype(np.float32)[:, None]
        self.met[rows] = self.done
        for g, v, own in zip(grads["x"], self.v["x"], p["x"]):
            g *= cut
            new = v[rows]
            new *= faded
            new += g * g
            v[rows] = new
            np.sqrt(new, out=new)
            new += least
            g /= new
            g *= np.float32(rate / deviation)
            own[rows] -= g


def fit(net: Recurrent, seqs: list[np.ndarray], first: int, window: int = 32, lanes: int = 48, passes: int = 2, rate: float = 8e-3) -> None:
    x, y, doc, reset = laid_out(seqs, lanes, first)
    mask = (doc >= 0).astype(np.float32)
    adam = Adam(net)
    updates = passes * -(-len(x) // window)
    for _ in range(passes):
        h = np.zeros((x.shape[1], net.hidden), np.float32)
        for t in range(0, len(x), window):
            s = slice(t, t + window)
            grads, h = net.gradients(x[s], y[s], mask[s], reset[s], h)
            adam.update(grads, rate * min(1.0, (adam.done + 1) / 20) * (1 - 0.9 * (adam.done + 1) / updates))


def fit_on(adam: Adam, seqs: list[np.ndarray], first: int, window: int = 32, rate: float = 2e-3) -> None:
    """Once more over some documents, where it is not known how many will follow. A text longer than
    an even share of a lane is fitted in pieces that start without a state, after the word before."""
    net = adam.net
    most = max(8 * window, -(-sum(map(len, seqs)) // LANES))
    parts = [(s, k) for s in seqs for k in range(0, len(s), most)]
    before = np.array([s[k - 1] if k else first for s, k in parts], np.int32)
    x, y, doc, reset = laid_out([s[k: k + most] for s, k in parts], LANES, before)
    mask = (doc >= 0).astype(np.float32)
    h = np.zeros((x.shape[1], net.hidden), np.float32)
    for t in range(0, len(x), window):
        s = slice(t, t + window)
        grads, h = net.gradients(x[s], y[s], mask[s], reset[s], h)
        adam.update(grads, rate * min(1.0, (adam.done + 1) / 20) / (1 + adam.done / 200) ** 0.5)


def fit_all(rows: DataFrame, net: Recurrent, first: int, rounds: int) -> None:
    """Fits `net` on by the outcomes of all `rows`, which have the `draw` of each."""
    sc = rows.sparkSession.sparkContext
    names, shapes = list(net.p), [a.shape for a in net.p.values()]
    cuts = np.cumsum([0, *(a.size for a in net.p.values())])
    for k in range(rounds):
        shared = sc.broadcast(net)

        def run(batches, shared=shared):
            mine, seen = copy.deepcopy(shared.value), 0
            adam = Adam(mine)
            kind = outcome_type(len(mine.cls))
            for whole in batches:
                for b in chunks(whole, "outcomes", FIT_TOKENS * kind.itemsize):
                    seqs = [np.frombuffer(o, kind).astype(np.int32) for o in b.column("outcomes").to_pylist()]
                    fit_on(adam, seqs, first)
                    seen += sum(map(len, seqs))
            if seen:
                flat = np.concatenate([a.ravel() for a in mine.p.values()])
                for at in range(0, len(flat), BLOCK):
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([seen], pa.int64()), pa.array([flat[at: at + BLOCK].tobytes()], pa.binary())],
                                                     ["at", "n", "part"])

        def mean(part: pa.Table) -> pa.Table:
            ns = part.column("n").to_pylist()
            total = sum(np.frombuffer(p, np.float32).astype(float) * n for p, n in zip(part.column("part").to_pylist(), ns))
            return pa.table({"at": part.column("at")[:1], "part": pa.array([(total / sum(ns)).astype(np.float32).tobytes()], pa.binary())})

        # One network for each core: what is averaged follows the machines, not the files.
        fitted = (rows.filter(F.pmod("draw", F.lit(rounds)) == k).select("outcomes").coalesce(max(1, sc.defaultParallelism)).mapInArrow(run, "at bigint, n bigint, part binary")
                  .groupBy("at").applyInArrow(mean, "at bigint, part binary").collect())
        if fitted:
            flat = np.frombuffer(b"".join(r["part"] for r in sorted(fitted, key=lambda r: r["at"])), np.float32)
            net.p = {name: flat[a:b].reshape(shape).copy() for name, shape, a, b in zip(names, shapes, cuts, cuts[1:])}


def document_scores(net: Recurrent, seqs: list[np.ndarray], first: int, rows: int = 1 << 14) -> np.ndarray:
    """Sum of natural logs over each sequence of outcomes, the state carried over all windows. Lanes
    stand by falling length, so those still at work are the first, and no place is kept for others."""
    lengths = np.array([len(s) for s in seqs])
    packed = pack(lengths, LANES)
    totals = np.array([int(lengths[lane].sum()) for lane in packed])
    active = np.searchsorted(-totals, -np.arange(totals[0]), "left")  # lanes longer than t
    offs = np.concatenate(([0], np.cumsum(active)))
    x, y, doc, reset = np.empty(offs[-1], np.int32), np.empty(offs[-1], np.int32), np.empty(offs[-1], np.int32), np.zeros(offs[-1], bool)
    for j, lane in enumerate(packed):
        if totals[j]:
            at = offs[: totals[j]] + j
            y[at] = joined = np.concatenate([seqs[d] for d in lane])
            doc[at] = np.repeat(lane, lengths[lane])
            begins = np.concatenate(([0], np.cumsum(lengths[lane])))[:-1][lengths[lane] > 0]
            before = np.concatenate(([first], joined[:-1]))
            before[begins] = first
            x[at] = before
            reset[at[begins]] = True
    out, bias = np.zeros(len(seqs)), net.biases(len(packed))
    h, f = np.zeros((len(packed), net.hidden), net.p["u"].dtype), net.p["u"].dtype
    t = 0
    while t < len(active):
        stop = max(t + 1, int(np.searchsorted(offs, offs[t] + rows, "right")) - 1)
        a, b = offs[t], offs[stop]
        gx = np.take(net.p["x"], x[a:b], axis=1)
        hs = np.empty((b - a, net.hidden), f)
        for i, j in zip((offs[t:stop] - a).tolist(), (offs[t + 1: stop + 1] - a).tolist()):
            n = j - i
            h = h[:n]
            begins = np.flatnonzero(reset[a + i: a + j])
            if len(begins):
                h = h.copy()
                h[begins] = 0
            net.cell(gx[:, i:j], h, bias[:, :n], hs[i:j])
            h = hs[i:j]
        out += np.bincount(doc[a:b], net.log_probs(hs, y[a:b]).astype(np.float64), len(seqs))
        t = stop
    return out


def lm_score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", n_words: int | None = None,
             head_words: int = 200_000, fit_docs: int = 700, rounds: int = 2) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row; `train` is a
    condition on the input that says which rows to learn from. `n_words` words have their own
    outcome; None takes those of the count threshold."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_ord"), F.col(id_col).cast("bigint").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
    counts = materialize(token_counts(rows.filter("train")))
    total = counts.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    n_types, n_train = int(total["v"]), int(total["n"])
    head = frequent_words(counts, head_words)
    unit = np.log10(n_train + 0.5 * (n_types + 1))
    if n_train and END not in dict(head):  # a tiny head must hold the end
        head.append((END, counts.filter(F.col("word") == F.lit(END)).first()["n"]))
    known = {w: i for i, (w, _) in enumerate(head)}
    head_logs = np.log10(np.array([n for _, n in head], float) + 0.5)
    least = n_train**0.5 / SHARE
    words = [i for i, (w, _) in enumerate(head) if w != END]
    if n_words is None:
        n_words = max(LEAST_WORDS, sum(head[i][1] >= least for i in words))
    own = [(head[i][1] + 0.5, i) for i in words[:n_words]] + [(head[i][1] + 0.5, i) for i in [known.get(END)] if i is not None]
    ends = ending_masses(counts, least, [head[i] for _, i in own])
    ranked = sorted([*((-m, b"", i) for m, i in own), *((-m - 0.5, e, -1) for e, m in ends.items())])
    other = n_train + 0.5 * (n_types + 1) - sum(m for m, _ in own) - sum(ends.values())
    masses = np.array([other, *(-r[0] for r in ranked)])
    ends = {e: k for k, (_, e, i) in enumerate(ranked, 1) if i < 0}
    # an own outcome has no share to divide
    share_log = np.array([np.log10(other) if n_train else 0.0, *(np.log10(-m) if i < 0 else 0.0 for m, _, i in ranked)])
    alone = np.array([False, *(i >= 0 for *_, i in ranked)])
    outcome = np.array([ends.get(w[-ENDING:], 0) for w, _ in head] + [0], np.int32)  # the last place is for words out of the head
    for k, (*_, i) in enumerate(ranked, 1):
        if i >= 0:
            outcome[i] = k
    sc = docs.sparkSession.sparkContext
    places = sc.broadcast((known, outcome, ends))
    net, first = None, 0
    if n_train:
        first = int(outcome[known[END]])
        net = Recurrent(masses)
        sample = bounded_sample(rows.filter("train"), fit_docs, "doc_id", "text").select("text").collect()
        fit(net, [_outcomes(t := tokens((r["text"] or "").encode()), _ids(t, known), outcome, ends) for r in sample], first)
    kind = outcome_type(len(masses))

    def code(batches):
        """Each text once: its outcomes, and its words out of the head with their numbers."""
        known, outcome, ends = places.value
        in_head, share_log, alone = logs.value
        for whole in batches:
            for b in chunks(whole, "text"):
                split = [tokens(t) for t in b.column("text").cast(pa.binary()).to_pylist()]
                lengths = np.array([len(w) for w in split])
                words = list(chain.from_iterable(split))
                ids = _ids(words, known)
                out = _outcomes(words, ids, outcome, ends)
                own, row, cuts = in_head[ids], np.repeat(np.arange(len(split)), lengths), np.cumsum([0, *lengths])
                inner = np.where(alone[out], 0.0, own - share_log[out])
                stray = np.flatnonzero(ids < 0)
                rest = [words[i] for i in stray.tolist()]
                at = np.searchsorted(stray, cuts).tolist()
                tails = [Counter(rest[i:j]) for i, j in zip(at, at[1:])]
                sent = out.astype(kind)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c) for c in ("row_ord", "doc_id", "train", "draw")),
                     pa.array([sent[i:j].tobytes() for i, j in zip(cuts.tolist(), cuts[1:].tolist())], pa.binary()),
                     pa.array(lengths, pa.int64()), pa.array(np.bincount(row, ids >= 0, len(split)).astype(np.int64)),
                     pa.array(np.bincount(row, own, len(split))), pa.array(np.bincount(row, inner, len(split))),
                     pa.array([list(t) for t in tails], pa.list_(pa.binary())), pa.array([list(t.values()) for t in tails], pa.list_(pa.int64()))],
                    ["row_ord", "doc_id", "train", "draw", "outcomes", "n_tokens", "n_head", "head_log", "inner_log", "words", "tfs"])

    logs = sc.broadcast((np.append(head_logs, 0.0), share_log, alone))
    coded = stored(rows.withColumn("draw", F.xxhash64(F.lit(13), "doc_id", "text")).mapInArrow(
        code, "row_ord bigint, doc_id bigint, train boolean, draw bigint, outcomes binary, n_tokens bigint, n_head bigint, "
              "head_log double, inner_log double, words array<binary>, tfs array<bigint>"))
    if n_train:
        fit_all(coded.filter("train"), net, first, rounds)
    shared = sc.broadcast((net, first))

    def run(batches):
        net, first = shared.value
        for whole in batches:
            for b in chunks(whole, "outcomes", SCORE_TOKENS * kind.itemsize):
                model = np.zeros(b.num_rows)
                if net is not None:
                    out = [np.frombuffer(o, kind) for o in b.column("outcomes").to_pylist()]
                    model = document_scores(net, out, first) / np.log(10) + b.column("inner_log").to_numpy()
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(model)], [*kept, "head_model"])

    kept = ["row_ord", "doc_id", "n_tokens", "n_head", "head_log"]
    tail = (coded.select("row_ord", F.explode(F.arrays_zip("words", "tfs")).alias("t")).select("row_ord", F.col("t.words").alias("word"), F.col("t.tfs").alias("tf"))
            .join(counts, "word", "left").groupBy(F.col("row_ord").alias("tail_ord"))
            .agg(F.sum(F.when(F.col("n").isNotNull(), F.col("tf")).otherwise(0)).alias("tail_known"),
                 F.sum(F.col("tf") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("tail_log")))
    scored = coded.select(*kept, "inner_log", "outcomes").mapInArrow(run, "row_ord bigint, doc_id bigint, n_tokens bigint, n_head bigint, head_log double, head_model double")
    tail_log = F.coalesce("tail_log", F.lit(0.0))
    base = F.col("head_log") + tail_log - F.col("n_tokens") * F.lit(float(unit))
    return scored.join(tail, F.col("row_ord") == F.col("tail_ord"), "left").select(
        "doc_id", "n_tokens", (F.col("n_head") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("bigint").alias("train_tokens"), base.alias("base_score"),
        (F.col("head_model") + tail_log if n_train else base).alias("score"))


def outcome_type(n: int) -> np.dtype:
    """Of the stored outcomes, of which there are `n`."""
    return np.dtype(np.uint16 if n <= 1 << 16 else np.int32)


def ending_masses(counts: DataFrame, least: float, without: list[tuple[bytes, int]]) -> dict[bytes, float]:
    """Add-half counts of the words of each ending but those of `without`, where their counts reach `least`."""
    found = (counts.filter(F.col("word") != F.lit(END)).groupBy(F.substring("word", -ENDING, ENDING).alias("end"))
             .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).filter(F.col("n") >= least).collect())
    left = {bytes(r["end"]): [r["n"], r["v"]] for r in found}
    for w, n in without:
        if w != END and w[-ENDING:] in left:
            left[w[-ENDING:]][0] -= n
            left[w[-ENDING:]][1] -= 1
    return {e: n + 0.5 * v for e, (n, v) in left.items() if v and n >= least}


def _outcomes(words: list[bytes], ids: np.ndarray, outcome: np.ndarray, ends: dict[bytes, int]) -> np.ndarray:
    out = outcome[ids]
    stray = np.flatnonzero(ids < 0)
    out[stray] = [ends.get(words[i][-ENDING:], 0) for i in stray.tolist()]
    return out


def _ids(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """Place in the head of each word, -1 for other words."""
    return np.fromiter(map(known.get, words, repeat(-1)), np.int32, len(words))
