"""Language identification, quality, language model and personal data."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from llm.helpers import corpus, frame
from loomgraph.llm import pii, queries
from loomgraph.llm.language_id import Classifier, dictionaries, identify
from loomgraph.llm.lm import END, Recurrent, document_scores, laid_out, lm_score, tokens
from loomgraph.llm.quality import Chain, fit_field, line_features, score_quality

FOLDER = "/root/testdata/sf0.01"


def auc(score, truth):
    ranks = pd.Series(score).rank()
    n1 = truth.sum()
    return (ranks[truth == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(truth) - n1))


def test_language_of_held_out_documents(spark):
    truth = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang").toPandas()
    got = queries.op2_language_id(spark, FOLDER).toPandas().merge(truth, on="doc_id")
    assert len(got) == len(truth) and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.96
    assert got.rejected.mean() < 0.03


def test_language_edges(spark):
    rows = corpus()
    train = frame(spark, rows).select("doc_id", "text", "lang")
    got = identify(frame(spark, rows), train).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for i in (9001, 9002, 9003):
        assert by_id[i]["lang_pred"] == "und" and by_id[i]["rejected"] and by_id[i]["score"] == 0
    none = identify(frame(spark, rows), train.limit(0)).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    one = Classifier({"en": b"some english text"})
    assert one.predict("words")[0] == "en" and one.predict("123")[0] == "und"
    assert identify(frame(spark, rows).limit(0), train).count() == 0


def test_dictionaries_hold_all_documents_and_not_their_common_head(spark):
    rng = random.Random(2)
    head = "this passage opens every text of all languages " * 30
    rows = []
    for lang in ("aa", "bb"):
        rows += [(i, head + " ".join(f"{lang}{i:03}x{rng.randrange(1000)}" for _ in range(600)), lang) for i in range(60)]
        rows += [(1000 + i, rows[-1][1], lang) for i in range(300)]  # copies
    train = spark.createDataFrame([(0, "w" * 3, "cc")] + rows, "doc_id bigint, text string, lang string")
    got = dictionaries(train)
    assert set(got) == {"aa", "bb", "cc"} and got["cc"] == b"www"
    for lang in ("aa", "bb"):
        assert 15_000 < len(got[lang]) <= 16 << 10
        seen = Counter(re.findall(rf"{lang}(\d\d\d)x", got[lang].decode()))
        assert len(seen) > 40 and max(seen.values()) < 60
        assert got[lang].count(b"passage opens") < 120  # a fifth of each text; 349 would fill the dictionary


def test_noise_and_mixtures_are_rejected(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("text is not null")
    rng = random.Random(9)
    by = {r["lang"]: r["text"] for r in docs.filter("length(text) > 600").dropDuplicates(["lang"]).collect()}
    noise = [(10**6 + i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(n)))
             for i, n in enumerate([300, 1000, 1500, 3000, 10000] * 30)]
    strange = [(2 * 10**6 + i, "".join(rng.choice(a) for _ in range(800))) for i, a in enumerate(["бвгджзклмн ", "αβγδεζηθικ ", "かきくけこさしすせそ"] * 5)]
    rows = spark.createDataFrame(noise + strange + list((3 * 10**6 + i, t) for i, t in enumerate(by.values())), "doc_id bigint, text string")
    got = identify(rows.unionByName(docs.select("doc_id", "text")), docs.select("doc_id", "text", "lang")).toPandas()
    assert got[got.doc_id < 10**6].rejected.mean() < 0.03
    assert got[got.doc_id.between(10**6, 2 * 10**6 - 1)].rejected.mean() > 0.95
    assert got[got.doc_id.between(2 * 10**6, 3 * 10**6 - 1)].rejected.mean() > 0.9
    assert not got[got.doc_id >= 3 * 10**6].rejected.any()


def test_rare_languages_are_learned(spark):
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    vocabulary = {f"l{k:03}": ["".join(rng.choice(letters) for _ in range(7)) for _ in range(12)] for k in range(300)}
    rows = [(k * 10 + j, " ".join(rng.choice(v) for _ in range(40)), lang) for k, (lang, v) in enumerate(vocabulary.items()) for j in range(3 - (k > 250))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = identify(docs, docs, dict_bytes=1 << 10).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang == got.lang_pred).all()
    texts = dictionaries(docs, dict_bytes=1 << 10)
    assert len(texts) == 300
    some = [r[1] for r in rows[::50]] + [None, "1"]
    assert Classifier(texts, block=7).measure(some) == Classifier(texts, block=300).measure(some)


def chain_by_hand(unary, trans):
    total, good = 0.0, np.zeros(len(unary))
    pair = np.zeros((len(unary) - 1, 2, 2))
    for labels in itertools.product((0, 1), repeat=len(unary)):
        p = math.exp(sum(u for u, y in zip(unary, labels) if y) + sum(trans[a, b] for a, b in zip(labels, labels[1:])))
        total += p
        good += p * np.array(labels)
        for t, (a, b) in enumerate(zip(labels, labels[1:])):
            pair[t, a, b] += p
    return good / total, pair / total


def test_forward_backward():
    rng = np.random.default_rng(0)
    counts = np.array([3, 0, 5, 1])
    unary, trans = rng.normal(size=9), rng.normal(size=(2, 2))
    good, at, pairs = Chain(counts).marginals(unary, trans, pairs=True)
    start = 0
    for n in counts:
        if n:
            want, want_pairs = chain_by_hand(unary[start: start + n], trans)
            np.testing.assert_allclose(good[start: start + n], want)
            np.testing.assert_allclose(pairs[(at >= start) & (at < start + n)], want_pairs)
        start += n


def test_line_features_see_lines_words_and_neighbours():
    x, size, counts = line_features(pa.array(["AB c\n\n a|b | c!\r\nAB c", None, " \n", "é é é"]))
    assert counts.tolist() == [3, 0, 0, 1] and size.tolist() == [4, 8, 4, 8]
    assert x[0, 8] == x[2, 8] == 1 and x[1, 8] == 0  # repeated line
    assert x[3, 7] == pytest.approx(2 / 3)  # words like the one before
    assert x[1, -2] == x[1, -1] == 1 and x[0, -2] == 0 and x[3, -1] == 0


def test_quality_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "quality").toPandas()
    got = queries.op4_quality_crf(spark, FOLDER).toPandas()
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert auc(held.score.to_numpy(), held.quality.to_numpy()) > 0.95
    assert (held.predicted[held.quality == 1] == 1).mean() > 0.97


def test_quality_edges(spark):
    rows = corpus()
    labels = spark.createDataFrame([(i * 7, i % 2, None) for i in range(40)] + [(0, 1, None), (None, 1, None), (7, None, None)], "doc_id bigint, quality int, toxic int")
    got = score_quality(frame(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in score_quality(frame(spark, rows), labels.limit(0)).collect()} == {0.5}
    assert score_quality(frame(spark, rows).limit(0), labels).count() == 0
    assert fit_field(["a", "b"], [1, 1]).scores(pa.array(["x", None])).tolist() == [0.75, 0.75]


def test_lm_base_scores_and_gain(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").toPandas()
    got = queries.op5_lm_score(spark, FOLDER).toPandas().merge(docs, on="doc_id")
    counts = Counter()
    for i, t in zip(docs.doc_id, docs.text):
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(tokens((t or "").encode()))
    n, v = sum(counts.values()), len(counts)
    unit = math.log10(n + 0.5 * (v + 1))
    for r in got.sample(120, random_state=0).itertuples():
        ts = tokens((r.text or "").encode())
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ts), sum(counts[t] > 0 for t in ts), n)
        assert r.base_score == pytest.approx(sum(math.log10(counts[t] + 0.5) for t in ts) - len(ts) * unit, rel=1e-9)
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()
    assert (got.score < 0).all()


def test_lm_words_out_of_the_head_are_joined(spark):
    rows = corpus()
    from pyspark.sql import functions as F

    whole = lm_score(frame(spark, rows), F.col("doc_id") % 2 == 0, fit_docs=5, n_words=20)
    small = lm_score(frame(spark, rows), F.col("doc_id") % 2 == 0, fit_docs=5, n_words=20, head_words=30)
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["base_score"])
    a, b = sorted(whole.collect(), key=key), sorted(small.collect(), key=key)
    assert len(a) == len(rows)
    for x, y in zip(a, b):
        assert (x["doc_id"], x["n_tokens"], x["n_known"], x["train_tokens"]) == (y["doc_id"], y["n_tokens"], y["n_known"], y["train_tokens"])
        assert x["base_score"] == pytest.approx(y["base_score"]) and x["score"] == pytest.approx(y["score"], rel=1e-4)
    none = lm_score(frame(spark, rows), F.lit(False)).collect()
    assert all(r["score"] == r["base_score"] and abs(r["score"]) < 1e-9 and r["train_tokens"] == 0 and r["n_known"] == 0 for r in none)
    assert lm_score(frame(spark, rows).limit(0), F.lit(True)).count() == 0


def test_lm_learns_from_all_documents_and_more_words_with_more_text(spark):
    from pyspark.sql import functions as F

    from loomgraph.llm import lm

    rng = random.Random(6)
    # pairs of words that follow each other, and rare words with two endings that do too
    def text():
        out = []
        for _ in range(60):
            k = rng.randrange(5000)
            out += rng.choice([[f"a{k}", f"b{k % 20}"], [f"q{rng.randrange(10**9)}xxx", f"r{rng.randrange(10**9)}yyy"]])
        return " ".join(out)

    rows = [(i, text(), None, None) for i in range(400)]
    shares, real = [], lm.Recurrent.__init__
    lm.Recurrent.__init__ = lambda self, masses, **more: (shares.append(masses), real(self, masses, **more))[1]
    try:
        few = lm_score(frame(spark, rows), F.col("doc_id") < 200, fit_docs=1).collect()
        none = lm_score(frame(spark, rows), F.col("doc_id") < 200, fit_docs=1, rounds=0).collect()
        lm_score(frame(spark, rows[:20]), F.lit(True), fit_docs=1, rounds=0)
    finally:
        lm.Recurrent.__init__ = real
    total = lambda found: sum(r["score"] for r in found if r["doc_id"] >= 200)
    assert total(few) > total(none)  # one document is fitted on the driver, the tasks learn from the others
    assert len(shares[0]) > max(2014, len(shares[2]))
    counts = Counter(w for _, t, *_ in rows[:200] for w in tokens(t.encode()))
    n, v = sum(counts.values()), len(counts)
    # all the mass is there: each word, and half a count for unseen words in outcome 0 and in each ending
    spare = (shares[0].sum() - n - 0.5 * v) * 2
    assert spare == pytest.approx(round(spare)) and 3 <= spare < 100  # outcome 0 and at least xxx and yyy


def test_lm_fits_long_texts_in_pieces():
    from loomgraph.llm import lm

    rng = np.random.default_rng(5)
    seqs = [rng.integers(0, 7, k).astype(np.int32) for k in (1, 5000, 3)]
    net = Recurrent(np.array([5.0, 3, 2, 1, 1, 1, 1]), hidden=4, width=3)
    seen = []
    plain = net.gradients
    net.gradients = lambda x, y, mask, reset, h: (seen.append((x, y, mask)), plain(x, y, mask, reset, h))[1]
    lm.fit_on(lm.Adam(net), seqs, 1)
    assert sum(m.sum() for *_, m in seen) == 5004
    pairs = Counter((int(a), int(b)) for x, y, m in seen for a, b in zip(x[m > 0], y[m > 0]))
    assert pairs == Counter((int(a), int(b)) for s in seqs for a, b in zip([1, *s[:-1]], s))


def test_network_is_a_distribution_and_carries_state():
    net = Recurrent(np.array([5.0, 3, 2, 1, 1, 1, 1]), hidden=4, width=3)
    rng = np.random.default_rng(1)
    for k in ("cw", "ww"):
        net.p[k] += rng.normal(size=net.p[k].shape).astype(np.float32)
    hs = rng.normal(size=(5, 4)).astype(np.float32)
    every = np.stack([net.log_probs(hs, np.full(5, y)) for y in range(7)])
    np.testing.assert_allclose(np.exp(every).sum(0), 1, rtol=1e-4)
    seqs = [rng.integers(0, 7, n).astype(np.int32) for n in (1, 200, 3, 70, 64)]
    got = document_scores(net, seqs, first=1)
    for s, g in zip(seqs, got):
        h, total, x = np.zeros((1, 4), np.float32), 0.0, 1
        for y in s:
            h, _ = net.step(np.array([x]), h)
            total += float(net.log_probs(h, np.array([y]))[0])
            x = y
        assert g == pytest.approx(total, rel=1e-4)


def test_lm_choices_are_small_and_hold_large_logits():
    from loomgraph.llm import lm

    masses = np.array([3.0, *(1e6 / np.arange(1, 17_000) ** 0.8)])
    net = Recurrent(masses, hidden=4)
    p, made = masses / masses.sum(), lambda shares, cuts: (np.add.reduceat(shares, cuts[:-1]) * np.diff(cuts)).sum()
    share = np.add.reduceat(p, net.cuts[:-1])
    assert net.cuts[:2].tolist() == [0, 1] and net.cuts[-1] == len(masses) and (np.diff(net.cuts) > 0).all()
    assert len(net.tops) + made(share, net.tops) + made(p, net.cuts) < 130  # 2 * 130 with classes of equal width
    hs, y = np.eye(4, dtype=np.float32), np.array([0, 1, 700, 16_999], np.int32)
    np.testing.assert_allclose(net.log_probs(hs, y), np.log(p[y]), rtol=1e-4)
    net.p["sw"] += np.float32(1000)  # no single number holds its exponential
    np.testing.assert_allclose(net.log_probs(hs, y), np.log(p[y]), rtol=1e-3)
    assert np.isfinite(net._outcome_gradients(hs, y, np.ones(4, np.float32))[1]).all()
    adam, before = lm.Adam(net), net.p["x"].copy()
    x = np.array([[5, 7], [7, 9]], np.int32)
    adam.update(net.gradients(x, x, np.ones((2, 2), np.float32), np.zeros((2, 2), np.float32), np.zeros((2, 4), np.float32))[0], 0.01)
    assert set(np.flatnonzero((net.p["x"] != before).any((0, 2)))) <= {5, 7, 9}


def test_lm_scores_a_long_text_beside_short_ones_without_padding():
    import tracemalloc

    net = Recurrent(np.array([5.0, 3, 2, 1, 1, 1, 1]), hidden=4, width=3)
    seqs = [np.ones(k, np.int32) for k in (30_000, *[3] * 255)]
    tracemalloc.start()
    got = document_scores(net, seqs, first=1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40 << 20  # 256 lanes of 30,000 places are over 120 MB
    assert got[0] < got[1] < 0 and got[1:] == pytest.approx(got[1])


def test_network_gradients():
    net = Recurrent(np.array([5.0, 3, 2, 1, 1, 1, 1]), hidden=3, width=3)
    rng = np.random.default_rng(2)
    net.p = {k: v.astype(np.float64) + 0.3 * rng.normal(size=v.shape) * (k != "wb") for k, v in net.p.items()}
    x, y, doc, reset = laid_out([rng.integers(0, 7, n).astype(np.int32) for n in (9, 4, 6)], 2, 1)
    mask, h0 = (doc >= 0).astype(float), np.zeros((2, 3))

    def loss():
        h, total = h0, 0.0
        for t in range(len(x)):
            h, _ = net.step(x[t], h * (1 - reset[t])[:, None])
            total -= (net.log_probs(h, y[t]) * mask[t]).sum()
        return total / mask.sum()

    grads, _ = net.gradients(x, y, mask, reset, h0)
    for name in ("x", "u", "b", "cw", "cb", "ww"):
        flat = net.p[name].reshape(-1)
        for i in rng.choice(flat.size, 6):
            old = flat[i]
            flat[i] = old + 1e-4
            up = loss()
            flat[i] = old - 1e-4
            down = loss()
            flat[i] = old
            assert grads[name].reshape(-1)[i] == pytest.approx((up - down) / 2e-4, abs=2e-5)


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, s):
    digits = [int(c) for c in s if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        double = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(double) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(4)
    bits = ["a", "b.c", "@", ".", "1", "22", "255.1.2.3", "4111 1111 1111 1111", "+1 (222) 555-0101", "-", " ", "%", "é", "\n", "x@y.zz", "..", "@@", "999", "_d", "(", "٣"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))
        want = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if passes(k, m.group())]
        assert pii.base_spans(text) == want, text


def test_long_texts_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "@" * 100_000, "+1" * 100_000, "1 " * 100_000):
        pii.base_spans(text)
        pii.SegmentField().spans(text, [])


def test_segments_are_chosen_jointly():
    rng = random.Random(8)
    text = "call: +1 222 333 4444 10.0.0.1 x1@y2.zz 77 888 9999"
    island = pii.islands(text)[-1]
    field = pii.SegmentField()
    segs = list(field.candidates(text, island))
    assert len(segs) > 5
    field.weights = {(k, f): rng.gauss(-0.4, 1) for k in pii.KINDS for *_, fs in segs for f in fs}
    got = field.decode(text, island)

    def best(i):
        if i >= len(island):
            return 0.0
        options = [best(i + 1)]
        for a, b, _, _, fs in segs:
            if a == i:
                options += [sum(field.weights[k, f] for f in fs) + best(b) for k in pii.KINDS]
        return max(options)

    worth = {(k, s, e): sum(field.weights[k, f] for f in fs) for _, _, s, e, fs in segs for k in pii.KINDS}
    assert sum(worth[x] for x in got) == pytest.approx(best(0))


def test_segment_posteriors():
    segs = [(0, 1, None), (0, 2, None), (1, 2, None), (1, 3, None)]
    score = np.array([0.3, -0.2, 0.7, 0.1])
    paths = [[], [0], [1], [2], [3], [0, 2], [0, 3]]
    weights = [math.exp(score[p].sum()) for p in paths]
    want = [sum(w for p, w in zip(paths, weights) if s in p) / sum(weights) for s in range(4)]
    np.testing.assert_allclose(pii._expected(3, segs, score), want)


def test_one_long_text_of_numbers_does_not_use_up_the_islands():
    mail = "write to joe@example.com today"
    for long in ("no 12 x " * 5000, "at 5550 1234567 x " * 5000):  # without candidates, and with them
        field = pii.fit_field([long] + [mail] * 20, steps=20, max_islands=100)
        assert sum(len(r) for r in pii.drawn_islands([long] + [mail] * 20, 100)[1:]) == 20
        assert pii.SegmentField.spans(field, "now ann@site.org here", []) == [("email", 4, 16)]
    assert not pii.fit_field(["no 12 x"]).weights


def test_pii_keeps_base_spans(spark):
    rows = corpus() + [(7001, "mail é joe@example.com, card 4111 1111 1111 1111 +1 (222) 555-0101 and 10.0.0.1!", "en", "s1")] * 2
    got = pii.find_pii(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    r = next(r for r in got if r["doc_id"] == 7001)
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1, 1)
    assert r["base"] == "email:7:22,ip:71:79,card:29:48,phone:49:66" and set(r["base"].split(",")) <= set(r["spans"].split(","))
    assert all(r["base"] == "" and r["spans"] == "" for r in got if r["doc_id"] in (9001, 9002, 9003))
    assert pii.find_pii(frame(spark, rows).limit(0)).count() == 0


def test_end_is_no_word():
    assert tokens(b"A \x0bB\n\n") == [b"a", b"b", END] and tokens(None) == [END]
