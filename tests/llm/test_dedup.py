"""Exact dedup, line dedup, substring dedup and the n-gram join against plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from llm.helpers import WORD, corpus, frame, words
from loomgraph.llm import ngram_join
from loomgraph.llm.exact_dedup import exact_dedup, keep_one_of_each
from loomgraph.llm.line_dedup import line_dedup
from loomgraph.llm.ngram_join import Rule, bitmap, boundary, keep_one_of_near, least_apart, may_link, near_duplicates, signatures
from loomgraph.llm.substring_dedup import COVER, PERIOD, substring_dedup
from loomgraph.llm.textops import word_bounds, word_hashes

BLANK = str.maketrans("", "", " \t\n\x0b\x0c\r")


def rank(row):
    return (-len(row[1] or ""), row[0] is None, row[0] or 0)


@pytest.mark.parametrize("max_bits", [1 << 28, 8])
def test_exact_dedup(spark, max_bits):
    rows = corpus() + [(i, "hot text", "en", "s1") for i in range(100, 140)] + [(50, "hot  text", "en", "s1")]
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(BLANK)].append(r)
    got = exact_dedup(frame(spark, rows), max_bits=max_bits).collect()
    want = Counter()
    for key, members in groups.items():
        best = min(members, key=rank)
        for m in members:
            want[(m[0], best[0], len(members), hashlib.sha256(key.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert len(kept) == len(groups) and set(kept.values()) == {1}
    for r in got:
        assert not r["kept"] or r["doc_id"] == r["keep_id"]


def test_exact_dedup_keeps_whole_rows(spark):
    rows = corpus()
    docs = frame(spark, rows)
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    best = {}
    for r in rows:
        key = (r[1] or "").translate(BLANK)
        best[key] = min(best.get(key, r), r, key=rank)
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter((r[0], r[1]) for r in best.values())


def test_line_dedup(spark):
    rng = random.Random(1)
    rows, sites = [], [f"site{i}" for i in range(20)] + [None]
    for i in range(200):
        lines = [" ".join(words(rng, 4, 60)), f"rare {i}", f"line {i % 17}", "", "  everywhere  ", f"some {i % 3}"]
        rows.append((i, "\n".join(lines[: rng.randrange(1, 7)]), "en", sites[(i * i) % 21 if i % 3 else i % 9]))
    rows += [(900, None, None, None), (901, "", None, "site1"), (902, "everywhere", None, None), rows[0], rows[0]]
    spread = defaultdict(set)
    for _, text, _, site in rows:
        for line in (text or "").split("\n"):
            spread[line.strip(" \t\n\x0b\x0c\r")].add(site)
    want = Counter()
    for i, text, _, _ in rows:
        parts = (text or "").split("\n")
        left = [p for p in parts if not p.strip(" \t") or len(spread[p.strip(" \t\n\x0b\x0c\r")]) < 6]
        want[(i, "\n".join(left), len(parts) if text else 0, len(parts) - len(left))] += 1
    got = line_dedup(frame(spark, rows), min_sites=6)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert sum(n for (_, _, _, gone), n in want.items() if gone) > 20


def removed(rows, window):
    """Words that stay, by a count of every window."""
    seqs = [WORD.findall(t or "") for _, t, _, _ in rows]
    seen = Counter(tuple(s[i: i + window]) for s in seqs for i in range(len(s) - window + 1))
    out = Counter()
    for (i, *_), s in zip(rows, seqs):
        gone = set()
        for k in range(len(s) - window + 1):
            if seen[tuple(s[k: k + window])] > 1:
                gone.update(range(k, k + window))
        left = [w for k, w in enumerate(s) if k not in gone]
        out[(i, len(s), len(gone), hashlib.sha256(" ".join(left).encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("window", [35, 22])
def test_substring_dedup(spark, window):
    rng = random.Random(5)
    rows = corpus(n=80)
    shared = words(rng, 50)
    for i in range(40):  # matches of every length around the window, at every shift
        k = rng.randrange(50 - window)
        rows.append((2000 + i, " ".join(words(rng, rng.randrange(30)) + shared[k: k + window + rng.randrange(-2, 12)] + words(rng, 9)), "en", "s1"))
    rows.append((5000, "again " * 90, "en", "s1"))
    rows.append((5001, "a b " * 20 + "é ü x " * 30, "en", "s1"))
    got = substring_dedup(frame(spark, rows), window=window)
    want = removed(rows, window)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert sum(1 for _, _, gone, _ in want if gone) > 30
    kept = substring_dedup(frame(spark, rows), window=window, with_text=True).collect()
    assert all(hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"] for r in kept)


def test_cover_aligns_any_two_positions():
    for i in range(PERIOD):
        for j in range(PERIOD):
            assert any((i + d) % PERIOD in COVER and (j + d) % PERIOD in COVER for d in range(PERIOD))


def shingles(text, size):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i: i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def linked(rows, size, num, den):
    sets = [shingles(r[1], size) for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    out = Counter()
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out[(r[0], len(sets[i]), min(ids, default=None) if sets[i] else r[0])] += 1
    return out


@pytest.mark.parametrize("size, num, den", [(3, 9, 10), (5, 4, 5)])
def test_near_duplicates(spark, size, num, den):
    rng = random.Random(9)
    rows = corpus(n=70)
    base = words(rng, 120)
    for i in range(45):  # a group of near copies, many just at the threshold
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(120)] = f"x{rng.randrange(50)}"
        rows.append((3000 + i, " ".join(w).upper() if i % 4 else " ".join(w), "en", "s1"))
    for i in range(30):  # a second generation that is linked below the threshold of the first
        w = list(base)
        w[10:22] = [f"y{i % 3}{k}" for k in range(12)]
        w[60 + i] = "z"
        rows.append((3500 + i, " ".join(w), "en", "s1"))
    for n in (8, 9, 10, 11, 12, 13, 24):  # chains of growing prefixes, small and at the boundary
        rows += [(4000 + 10 * n + k, " ".join(base[: n + k]), "en", "s1") for k in range(3)]
    rows += [(5000 + i, " ".join(words(rng, 30) + base[:25]), "en", "s1") for i in range(20)]
    want = linked(rows, size, num, den)
    got = near_duplicates(frame(spark, rows), size=size, num=num, den=den)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == want
    kept = keep_one_of_near(frame(spark, rows), size=size, num=num, den=den)
    assert kept.columns == frame(spark, rows).columns
    left = Counter(r["doc_id"] for r in kept.collect() if shingles(r["text"], size))
    assert left == Counter(c for c in {(c, n > 0) for _, n, c in want if n} for c in [c[0]])


@pytest.mark.parametrize("blind", [False, True])
def test_copies_below_the_threshold_make_no_pairs(spark, monkeypatch, blind):
    """Copies with words of their own, linked with their origin or, blind to frequencies, with nothing."""
    rng, rows, pairs, apart = random.Random(4), [], [], ngram_join.Join.apart
    base = words(rng, 150)
    for i in range(160):
        w = list(base)
        for k in range(9 if blind else 2 + i % 3 // 2):
            w[rng.randrange(15) + 15 * k] = f"own{i}x{k}"
        rows.append((i, " ".join(w), "en", "s1"))
    rows.append((160, " ".join(base), "en", "s1"))
    if blind:  # as sketches are that are full
        none = np.zeros(1 << ngram_join.SKETCH_BITS, np.uint8)
        monkeypatch.setattr(ngram_join, "SLICE", 5000)
        monkeypatch.setattr(ngram_join, "frequency_levels", lambda parts: (none, none))
    monkeypatch.setattr(ngram_join.Join, "apart", lambda self, p: pairs.append(p.count()) or apart(self, p))
    got = near_duplicates(frame(spark, rows), size=3, num=9, den=10)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == linked(rows, 3, 9, 10)
    assert pairs[1] < 4 * len(rows)  # the pairs of one list, after those with hubs


def test_prefix_signatures_find_every_linked_pair():
    rng = np.random.default_rng(2)
    for num, den in ((9, 10), (4, 5)):
        rule = Rule(3, num, den)
        for _ in range(400):
            pool = rng.integers(0, 2**63, 400, dtype=np.uint64) * np.uint64(2)
            n = int(rng.integers(rule.smallest, 150))
            a = np.unique(pool[:n])
            drop, add = int(rng.integers(0, n // 8 + 2)), int(rng.integers(0, n // 8 + 2))
            b = np.unique(np.concatenate((a[drop:], pool[n: n + add])))
            common = len(np.intersect1d(a, b))
            if rule.links(len(a), len(b), common) and len(a) != common:
                for light in (0, 16, 64, 512):
                    mine, other = (dict(zip(*(x.tolist() for x in signatures(s, s % np.uint64(7), light, rule)))) for s in (a, b))
                    bound = max(min(mine[k], other[k]) for k in mine.keys() & other.keys())  # in the list of the first common elements
                    assert bound >= common >= rule.overlap(len(a), len(b))
                assert may_link(bitmap(a), bitmap(b), len(a), len(b), rule)
            assert least_apart(bitmap(a), bitmap(b), len(a), len(b)) <= len(a) + len(b) - 2 * common


def test_boundary_follows_cost():
    rule = Rule(3, 9, 10)
    assert boundary([(12, 1000)], 0, rule) >= 12
    assert boundary([(400, 1000)], 10**6, rule) < 400


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_regular_words_do_not_collide(spark, n):
    """Words that differ in every letter, of a form for which sums of powers are equal."""
    tail = " ".join(f"t{i}" for i in range(34))
    rows = [(1, f"{thue_morse(n)} {tail}", None, None), (2, f"{thue_morse(n, 'b', 'a')} {tail}", None, None)]
    assert sorted((r["doc_id"], r["n_removed"]) for r in substring_dedup(frame(spark, rows)).collect()) == [(1, 0), (2, 0)]
    short = [(i, t.split(" t9 ")[0].replace(" ", "  "), None, None) for i, t, _, _ in rows]
    short = [(i, " ".join([*t.split()[:1], "x", "y"]), None, None) for i, t, _, _ in short]
    assert sorted((r["doc_id"], r["component_id"]) for r in near_duplicates(frame(spark, short), size=3, num=9, den=10).collect()) == [(1, 1), (2, 2)]


def test_word_hashes_depend_on_the_bytes_alone():
    rng = random.Random(9)
    words = {bytes(rng.randrange(33, 127) for _ in range(n)) for n in (1, 2, 7, 8, 9, 15, 16, 17, 63, 64, 65, 200) for _ in range(50)}
    words |= {b"a" * n for n in range(1, 140)} | {"été".encode(), "ÉTÉ".encode(), b"A", b"a"}
    seen = {}
    for lead in (b"", b"xx ", b"some other words "):
        order = rng.sample(sorted(words), len(words))
        raw = np.frombuffer(lead + b" ".join(order), np.uint8)
        starts, ends, _ = word_bounds(raw, np.array([0, len(raw)]))
        for w, h in zip([*lead.split(), *order], word_hashes(raw, starts, ends).tolist()):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    both = np.frombuffer(b"ABC\xc3\x89 abc\xc3\x89", np.uint8)
    starts, ends, _ = word_bounds(both, np.array([0, len(both)]))
    assert len(set(word_hashes(both, starts, ends, lower=True).tolist())) == 1
