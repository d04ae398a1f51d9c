"""Mixing, decontamination and the pipeline."""

import random

import pytest

import corpus_pipeline
from llm.helpers import CLASHES, WORD, corpus, frame
from loomgraph.llm.decontamination import Matcher, budget, clean_documents, find_items, myers_best, normal, pattern_masks
from loomgraph.llm.exact_dedup import exact_dedup, keep_one_of_each
from loomgraph.llm.line_dedup import line_dedup
from loomgraph.llm.mixing import fill, min_cost_flow, mix_sources, route, targets
from loomgraph.llm.ngram_join import keep_one_of_near, near_duplicates
from loomgraph.llm.substring_dedup import substring_dedup
from pyspark.sql import functions as F


def test_targets():
    assert targets([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    got = targets([10, 1000, 1000], [1, 2, 3])
    assert got[0] == 30 and sum(got) == pytest.approx(2010) and got[1] * 3 == pytest.approx(got[2] * 2)
    assert targets([0, 0], [1, 2]) == [0, 0] and targets([], []) == []
    assert targets([0, 5], [1, 2]) == [0, 5]


def cheapest(patterns, quotas, costs=(1, 2, 4)):
    """Most flow, then least cost, by trying all amounts for each pattern and source."""
    best = None

    def go(i, left, flow, cost):
        nonlocal best
        if i == len(patterns):
            best = min(best or (1, 0), (-flow, cost))
            return
        members, cap = patterns[i]

        def split(k, room, rest, used):
            if k == len(members):
                price = sum(c * max(0, min(used - j * cap, cap)) for j, c in enumerate(costs))
                go(i + 1, rest, flow + used, cost + price)
                return
            for x in range(min(room, rest[members[k]]) + 1):
                split(k + 1, room - x, [r - x * (j == members[k]) for j, r in enumerate(rest)], used + x)

        split(0, cap * len(costs), left, 0)

    go(0, quotas, 0, 0)
    return best


def test_flow_is_optimal():
    rng = random.Random(3)
    for _ in range(40):
        quotas = [rng.randrange(6) for _ in range(rng.choice([1, 2]))]
        patterns = [(sorted(rng.sample(range(len(quotas)), rng.randrange(1, len(quotas) + 1))), rng.randrange(4)) for _ in range(rng.choice([1, 2, 3]))]
        flow = min_cost_flow(patterns, quotas)
        cost = sum(c * max(0, min(f - j * cap, cap)) for f, (_, cap) in zip(flow, patterns) for j, c in enumerate((1, 2, 4)))
        assert (-sum(flow), cost) == cheapest(patterns, quotas)
        assert sum(route(patterns, quotas)) == sum(flow)


def test_fill_comes_near():
    assert fill([5, 3, 9, 0], 8) == [True, True, False, False]
    assert fill([10], 4) == [False] and fill([10], 6) == [True]
    assert fill([], 3) == [] and fill([2], 0) == [False]


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 40)), "en", rng.choice(["a", "b", "c", "d", None])) for i in range(900)]
    rows += [(5000, "one two", "en", "tiny"), (5001, None, "en", "void"), rows[0], rows[0], (None, None, None, None)]
    docs = frame(spark, rows)
    got = mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert len(got) == len(rows)
    source = {r[0]: r[3] for r in rows}
    sizes, taken, target = {}, {}, {}
    for r in got:
        s = source[r["doc_id"]]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        target[s] = r["target"]
        assert r["size"] == len(WORD.findall(next(x[1] for x in rows if x[0] == r["doc_id"]) or ""))
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
    names = ["a", "b", "c", "d", "tiny", "void", None]
    want = targets([sizes[s] for s in names], [1, 2, 3, 1, 2, 3, 1])
    for s, t in zip(names, want):
        assert target[s] == pytest.approx(t) and abs(taken[s] - t) <= 3
    assert all(r["source_size"] == sizes[source[r["doc_id"]]] for r in got)
    again = mix_sources(docs.repartition(5)).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mix_sources(docs.limit(0)).count() == 0


def test_mix_of_overlapping_sources(spark):
    rows = [(i, "w " * 10, ["a", "b"] if i % 3 == 0 else ["a"] if i % 3 == 1 else []) for i in range(300)] + [(1000, "w", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, tags array<string>")
    got = mix_sources(docs, sources=F.col("tags")).collect()
    assert len(got) == len(rows) and abs(sum(r["taken"] for r in got) - 3001) <= 20
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    with pytest.raises(ValueError):
        mix_sources(docs, sources=F.col("tags"), max_patterns=2)


def edit_distance_within(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def mutated(rng, s, n):
    s = list(s)
    for _ in range(n):
        k = rng.randrange(len(s) or 1)
        s[k: k + 1] = rng.choice([[], ["x"], [*s[k: k + 1], "q"]])
    return "".join(s)


def test_myers():
    rng = random.Random(6)
    for _ in range(300):
        item = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 90)))
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(60))) + mutated(rng, item, rng.randrange(6)) + "cab"
        assert myers_best(pattern_masks(item), len(item), text, 200) == edit_distance_within(item, text)


def test_items_are_found_within_their_budget():
    rng = random.Random(7)
    items = [(i, normal(" ".join("".join(rng.choice("abcd") for _ in range(4)) for _ in range(rng.randrange(5, 50))))) for i in range(12)] + [(50, ""), (51, "short one")]
    m = Matcher(items, 0.05, 12)
    hits = 0
    for _ in range(150):
        item = rng.choice(items[:12])[1]
        text = normal("ab cd " * rng.randrange(5) + mutated(rng, item, rng.randrange(8)) + " dc ba" + rng.choice(["", " short one"]))
        want = {i: edit_distance_within(x, text) for i, x in items if x}
        want = {i: d for i, d in want.items() if d <= budget(len(dict(items)[i]), 0.05, 12)}
        assert m.find(text) == want
        hits += len(want)
    assert hits > 60


def test_decontamination(spark):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    rows = corpus() + [(8001, f"start {item.upper()} end", "en", "s"), (8002, item.replace("gamma", "gemma").replace(" ", "\n"), "en", "s"), (8003, item[:40], "en", "s")]
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, "not there at all"), (1, "another text for item one")], "item_id bigint, text string")
    for chars in (1 << 20, 30):  # one block and several
        got = sorted(tuple(r) for r in find_items(frame(spark, rows), bench, block_chars=chars).collect())
        assert got == [(8001, 1, 0), (8002, 1, 1)]
        kept = clean_documents(frame(spark, rows), bench, block_chars=chars)
        assert kept.columns == frame(spark, rows).columns and kept.count() == len(rows) - 2
    assert find_items(frame(spark, rows), bench.limit(0)).count() == 0
    assert clean_documents(frame(spark, rows).limit(0), bench).count() == 0


def test_texts_of_one_item_give_one_row_whatever_the_blocks(spark):
    texts = [f"item text number {k} with words enough to be cut {'abcdefgh'[k]}" for k in range(8)]
    bench = spark.createDataFrame([(i, t) for i in (1, 2) for t in texts], "item_id bigint, text string")
    docs = frame(spark, [(5, " and ".join(texts), "en", "s"), (6, texts[3].replace("enough", "enouhg"), "en", "s")])
    one = sorted(tuple(r) for r in find_items(docs, bench, min_piece=8).collect())
    assert [r[:2] for r in one] == [(5, 1), (5, 2), (6, 1), (6, 2)]
    assert sorted(tuple(r) for r in find_items(docs, bench, min_piece=8, block_chars=60).collect()) == one


@pytest.mark.parametrize("op", [exact_dedup, keep_one_of_each, line_dedup, substring_dedup, near_duplicates, keep_one_of_near, mix_sources])
def test_awkward_tables(spark, op):
    empty = frame(spark, corpus()).limit(0)
    assert op(empty).count() == 0
    nulls = frame(spark, [(None, None, None, None)] * 3)
    assert 1 <= op(nulls).count() <= 3
    long = frame(spark, [(1, "word " * 60_000 + "end", "en", "s"), (1, "word " * 60_000 + "end", "en", "s"), (2, "x" * 300_000, None, None)])
    assert 2 <= op(long).count() <= 3


def test_short_items_are_words_of_their_own(spark):
    texts = ["they concatenate strings", "the cat sat", "CAT", "cats", "a cat.", "scat cat", "", None, "con-cat-enate"]
    docs = frame(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    items = spark.createDataFrame([(1, "cat"), (2, "...")], "item_id bigint, text string")
    assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in find_items(docs, items).collect()) == [(i, 1, 0) for i in (1, 2, 4, 5, 8)]
    assert sorted(r["doc_id"] for r in clean_documents(docs, items).collect()) == [0, 3, 6, 7]


def test_pipeline_stages(spark, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_join", "decontamination", "mixing"]
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({c: F.lit("x") for c in CLASHES})
    for name, stage in corpus_pipeline.STAGES:
        for some in (docs, docs.limit(0)):
            out = stage(spark, some, folder)
            if name != "mixing":
                assert out.columns == docs.columns and out.count() <= some.count()
            else:
                assert out.count() == some.count()
