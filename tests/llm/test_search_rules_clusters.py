"""Lexical search, quality rules and centroid clustering against plain Python."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from llm.helpers import CLASHES, DDL, WORD, corpus, frame
from loomgraph.llm.clustering import candidates, cluster_vectors, hilbert_keys, nearest
from loomgraph.llm.lexical_search import lexical_search
from loomgraph.llm.quality_rules import Forest, best_step, measure, quality_rules, repeated_words, rule_statistics

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- lexical search ---------------------------------------------------------------------


def searched(docs, items, top):
    terms = [TERM.findall((t or "").translate(LOWER)) for _, t in docs]
    n_docs, n_terms = sum(map(bool, terms)), sum(map(len, terms))
    df = collections.Counter(t for own in terms for t in set(own))
    wanted = collections.defaultdict(set)
    for i, t in items:
        wanted[i] |= set(TERM.findall((t or "").translate(LOWER)))
    out = []
    for i, own in wanted.items():
        found = []
        for (doc_id, _), have in zip(docs, terms):
            m = 50 + (50 * len(have) * n_docs) // n_terms if n_terms else 0
            tf = collections.Counter(have)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 20 * m))
                        for t in own if tf[t])
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        out += [(i, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def item_frame(spark, items):
    return spark.createDataFrame([(i, t, *["x"] * len(CLASHES)) for i, t in items],
                                 "item_id bigint, text string, " + ", ".join(f"{c} string" for c in CLASHES)).repartition(2)


def test_lexical_search_matches_brute_force(spark):
    docs = corpus(n=60) + [(77, "Été ÉTÉ a-b_c 9x\x009x", "en", "s"), (78, "w1 " * 3000 + "w2", "en", "s")]
    items = [(1, "w1 w2 W3 w1"), (2, "changed été"), (2, "9x b"), (3, None), (None, "w5 w6 w7"), (4, "no-such-term"), (5, " ".join(f"w{k}" for k in range(300)))]
    want = searched([d[:2] for d in docs], items, 5)
    for owners, bundle, chunk, pairs in ((4, 512, 1 << 20, 1 << 20), (3, 2, 400, 1 << 20), (2, 1, 4000, 20)):
        got = lexical_search(frame(spark, docs), item_frame(spark, items), top=5, owners=owners, bundle_items=bundle, chunk_bytes=chunk, block_pairs=pairs)
        assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
        assert sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == want


def test_lexical_search_breaks_ties_by_id(spark):
    docs = [(i, "same words here", None, None) for i in range(40, 0, -1)] + [(None, "same words here", None, None)]
    got = lexical_search(frame(spark, docs, 4), item_frame(spark, [(1, "words"), (2, "here same")]), top=3, chunk_bytes=60)
    assert sorted((r["item_id"], r["rank"], r["doc_id"]) for r in got.collect()) == [(i, k, k) for i in (1, 2) for k in (1, 2, 3)]


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, "a", "", "")], []), ([(1, None, None, None)], [(1, "a")]), ([(1, "a", "", "")], [(None, None)])])
def test_lexical_search_of_nothing(spark, docs, items):
    assert lexical_search(frame(spark, docs), item_frame(spark, items)).collect() == []


# --- centroid clustering ----------------------------------------------------------------


def clustered(rows, dim, k, rounds, scale=256):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        near = assign()
        for n in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, near) if c == n]
            if own:
                centroids[n] = [sum(col) // len(own) for col in zip(*own)]
    near = assign()
    inertia = collections.Counter()
    for d, c in near:
        inertia[c] += d
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), shas[c]) for (i, _), (d, c) in zip(kept, near)), key=str)


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "x", "x") for i, v in rows], "vec_id bigint, embedding array<float>, v string, cluster string, key string").repartition(3)


@pytest.mark.parametrize("spread, scale", [(1.0, 256), (0.01, 256), (1.0, 1 << 22)])
def test_clusters_match_brute_force(spark, spread, scale):
    rng = random.Random(5)
    centres = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [float(np.float32(c + rng.gauss(0, spread))) for c in centres[i % 6]]) for i in range(300)]
    rows += [(7, rows[7][1])] * 90 + [(None, rows[3][1]), (5, rows[9][1])]  # repeated rows and ids
    rows += [(900, None), (901, [0.0] * 7), (902, [float("nan")] * 8), (903, [None] + [0.0] * 7), (904, [float("inf")] * 8), (905, [])]
    got = cluster_vectors(vector_frame(spark, rows), dim=8, k=12, rounds=3, block_rows=16, scale=scale)
    assert sorted((tuple(r) for r in got.collect()), key=str) == clustered(rows, 8, 12, 3, scale)


def test_clusters_of_few_or_no_vectors(spark):
    assert cluster_vectors(vector_frame(spark, [])).collect() == []
    assert cluster_vectors(vector_frame(spark, [(1, None), (2, [1.0])])).collect() == []
    few = [(i, [0.5 * i] * 64) for i in range(3)] + [(9, [0.5] * 64)]
    got = cluster_vectors(vector_frame(spark, few))
    assert sorted((tuple(r) for r in got.collect()), key=str) == clustered(few, 64, 40, 5)


def test_components_too_large_raise(spark):
    with pytest.raises(Exception, match="beyond"):
        cluster_vectors(vector_frame(spark, [(1, [1e30] * 64)])).collect()


def test_curve_visits_every_cell_by_steps_of_one():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    keys = hilbert_keys(cells, 3)
    path = cells[np.argsort(keys)]
    assert sorted(keys.tolist()) == list(range(512)) and (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_boxes_leave_the_nearest_centroids_and_prune():
    rng = np.random.default_rng(3)
    centroids = rng.integers(-200, 200, (40, 16))
    for _ in range(50):
        v = centroids[rng.integers(40)] + rng.integers(-12, 12, (64, 16))
        near = candidates(v.min(axis=0), v.max(axis=0), centroids)
        best, distance = nearest(v, centroids[near])
        whole = ((v[:, None] - centroids) ** 2).sum(axis=2)
        assert (near[best] == whole.argmin(axis=1)).all() and (distance == whole.min(axis=1)).all() and len(near) < 20


# --- quality rules ----------------------------------------------------------------------


def measured(text):
    t = text or ""
    words = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), sum(x in lines[:k] for k, x in enumerate(lines)), len(covered), len(lines))


def test_statistics_match_brute_force(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(30))) for _ in range(40)]
    texts += ["été x \n a |b \n\n a |b \na |b \r\n a |b ", "é" * 9 + " <tag> $$", None, "", " \n\t", "a b c d a b c", "x " * 20000, "long" * 200000]
    for t in texts:
        assert measure(None if t is None else t.encode()) == measured(t)
    rows = [(i, t, None, None) for i, t in enumerate(texts)] + [(None, "a b", None, None)] * 2
    got = rule_statistics(frame(spark, rows)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, *measured(t))) for i, t, _, _ in rows)


def test_repeated_words_of_short_texts():
    assert [repeated_words([b"a"] * n) for n in range(6)] == [0, 0, 0, 0, 4, 5]


def quality_corpus():
    rng = random.Random(8)
    out, labels = [], []
    for i in range(240):
        bad = i % 8 == 0
        w = ["".join(rng.choice("abcdefg") for _ in range(rng.randrange(3, 7))) for _ in range(rng.randrange(55, 200))]
        if bad:
            n = rng.randrange(1, 9)
            w = [x + n * rng.choice("#$%|") for x in w]
        out.append((i, " ".join(w), None, None))
        if i % 2 == 0 or i % 9 == 0:
            labels.append((i, int(not bad)))
    return out, labels


def label_frame(spark, labels):
    return spark.createDataFrame([(i, q, "x", "x") for i, q in labels], "doc_id bigint, quality int, kept string, form string")


def test_rules_reject_junk_and_keep_clean_documents(spark):
    docs, labels = quality_corpus()
    extra = [(1000, None, None, None), (1001, "", None, None), (1002, "only a few words", None, None), (1003, "same words again " * 60, None, None), (None, docs[1][1], None, None), docs[0], docs[0]]
    got = {(r["doc_id"], r["n_words"]): (r["base_failed"], r["kept"]) for r in quality_rules(frame(spark, docs + extra), label_frame(spark, labels)).collect()}
    for i, t, _, _ in docs + extra:
        m = measured(t)
        failed = m[0] < 50 or 100 * m[4] > 50 * m[0]
        assert got[i, m[0]][0] == failed
        assert not (failed and got[i, m[0]][1])
    kept = [got[i, measured(t)[0]][1] for i, t, _, _ in docs]
    junk, clean = kept[::8], [k for i, k in enumerate(kept) if i % 8]
    assert sum(junk) <= 2 and sum(clean) >= 0.97 * len(clean)
    assert got[None, measured(docs[1][1])[0]][1]


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)], [(None, 0), (0, 7)]])
def test_without_both_labels_the_base_rules_decide(spark, labels):
    docs, _ = quality_corpus()
    assert all(r["kept"] == (not r["base_failed"]) for r in quality_rules(frame(spark, docs[:30]), label_frame(spark, labels)).collect())


def test_rules_of_nothing(spark):
    assert quality_rules(frame(spark, []), label_frame(spark, [])).collect() == []
    short = quality_rules(frame(spark, [(1, "few", None, None), (2, None, None, None)]), label_frame(spark, [(1, 1)])).collect()
    assert [(r["base_failed"], r["kept"]) for r in short] == [(True, False)] * 2


def test_forest_sets_outliers_apart_and_paths_follow_the_splits():
    rng = np.random.default_rng(4)
    x = np.concatenate((rng.normal(0, 1, (500, 2)), [[9.0, 9.0], [-8.0, 7.0]]))
    forest = Forest(x, 60, 128, 1)
    s = forest.scores(x)
    assert s[500:].min() > np.quantile(s[:500], 0.98)
    tree = forest.trees[0]
    for row in x[:20]:
        at = 0
        while tree.column[at] >= 0:
            at = tree.left[at] if row[tree.column[at]] < tree.cut[at] else tree.right[at]
        assert tree.paths(row[None])[0] == tree.path[at]


def test_threshold_is_the_best_within_the_allowed_loss():
    good, bad = np.zeros(11, int), np.zeros(11, int)
    good[[2, 3, 5, 8]] = 100, 97, 2, 1
    bad[[5, 6, 8]] = 1, 20, 5
    assert best_step(good, bad, 0.01) == 6 and best_step(good, bad, 0.001) is None
    assert best_step(good, np.zeros(11, int), 0.5) is None and DDL
