import itertools
import math
import statistics
import tracemalloc

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from loomgraph.external import HashingEmbedder, embed_texts
from loomgraph.functions import vectors as V
from loomgraph.operators import retrieval as R, similarity as S, vector_store as VS

RNG = np.random.default_rng(3)


@pytest.fixture(scope="module")
def table(spark):
    """Random vectors in two fields, with copies, a null and a zero vector."""
    data = []
    for field in ("define", "problem"):
        base = RNG.normal(size=(60, 5))
        base[10:30] = base[10]
        for i, v in enumerate(base):
            data.append((field, f"n{i:02d}", v.tolist()))
        data += [(field, "null", None), (field, "zero", [0.0] * 5)]
    return data, spark.createDataFrame(data, "field string, id string, vec array<double>")


def by_hand(data):
    out = {}
    for (fa, a, x), (fb, b, y) in itertools.combinations(data, 2):
        if fa == fb and x is not None and y is not None and any(x) and any(y):
            x_, y_ = np.array(x), np.array(y)
            s = float(x_ @ y_ / (np.linalg.norm(x_) * np.linalg.norm(y_)))
            out[(fa, min(a, b), max(a, b))] = round(s, 3)
    return out


@pytest.mark.parametrize("tile", [7, 2048])
def test_all_pairs(spark, table, tile):
    data, df = table
    want = by_hand(data)
    grouped = S.pairs(df, -1.0, tile)
    assert grouped.count() < len(want) and grouped.agg(F.sum("node_pairs")).first()[0] == len(want)
    got = {(r["field"], r["a"], r["b"]): r["sim"] for r in S.node_pairs(grouped, df).collect()}
    assert got == pytest.approx(want)
    some = {(r["field"], r["a"], r["b"]) for r in S.node_pairs(S.pairs(df, 0.3, tile), df).collect()}
    assert some == {k for k, s in want.items() if s >= 0.3}


@pytest.mark.parametrize("tile", [7, 2048])
def test_stats_and_top(spark, table, tile):
    data, df = table
    want = by_hand(data)
    for r in S.stats(df, tile).collect():
        sims = [s for k, s in want.items() if k[0] == r["field"]]
        assert r["pairs"] == len(sims)
        assert (r["min_sim"], r["max_sim"]) == (min(sims), max(sims))
        assert r["mean_sim"] == pytest.approx(statistics.mean(sims))
        assert r["median_sim"] == pytest.approx(statistics.median(sims))
    top = S.top_pairs(df, 25, tile).collect()
    for field in ("define", "problem"):
        pairs = sorted((-s, a, b) for (f, a, b), s in want.items() if f == field)[:25]
        assert sorted((-r["sim"], r["a"], r["b"]) for r in top if r["field"] == field) == pairs


def test_far_tiles_are_skipped(spark):
    """Vectors in narrow cones: few pairs of tiles can reach the floor, and none is missed."""
    rng = np.random.default_rng(5)
    cones = rng.normal(size=(12, 8))
    data = [("f", i, (cones[i % 12] + 0.02 * rng.normal(size=8)).tolist()) for i in range(360)]
    df = spark.createDataFrame(data, "field string, id int, vec array<double>")
    plan = S.tile_plan(S.checked(S.distinct_vectors(df)), 8)
    reach = plan.reachable("f", 0.98)
    assert (reach == reach.T).all() and reach.sum() < reach.size / 4
    got = {(r["a"], r["b"]) for r in S.pairs(df, 0.98, 8).collect()}
    units = np.array([v for _, _, v in data])
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    sims = np.round(units @ units.T, 3)
    assert got == {(i, j) for i in range(360) for j in range(i + 1, 360) if sims[i, j] >= 0.98}
    best = sorted((-sims[i, j], i, j) for i in range(360) for j in range(i + 1, 360))[:7]
    assert sorted((-r["sim"], r["a"], r["b"]) for r in S.top_pairs(df, 7, 8).collect()) == best


@pytest.mark.parametrize("vec", [[1.0], [1.0, float("nan")]])
def test_bad_vectors_are_named(spark, vec):
    df = spark.createDataFrame([("f", "a", [1.0, 2.0]), ("f", "bad", vec)], "field string, id string, vec array<double>")
    for run in (S.stats, S.top_pairs, lambda d: S.pairs(d, 0.1)):
        with pytest.raises(ValueError, match="bad"):
            run(df)


def test_family(spark):
    labels = spark.createDataFrame([("a", "GraphRAG x"), ("b", "other"), ("c", "lightrag")], "id string, label string")
    assert rows(S.family(labels, ["graphrag", "LightRAG"]), "id") == [("a",), ("c",)]


def test_overlay_leaves_out_pairs_of_the_same_papers(spark):
    x, y = [1.0, 0.0], [0.6, 0.8]
    vectors = spark.createDataFrame(
        [("problem", k, v) for k, v in (("a", x), ("b", x), ("c", y), ("d", x), ("e", [0.0, 1.0]), ("gone", x))]
        + [("define", "a", x), ("define", "e", x)], "field string, id string, vec array<double>")
    nodes = spark.createDataFrame([(k,) for k in "abcde"], "key string")
    papers = spark.createDataFrame(
        [("a", "1"), ("a", "2"), ("b", "2"), ("b", "1"), ("c", "1"), ("c", "1"), ("d", "1")], "key string, pid string")
    # a, b, d are one vector: a-b stem from the same papers, a-d and b-d do not; c-d do
    assert rows(S.overlay(vectors, papers, 0.5, nodes)) == [("a", "a", 1.0, 2), ("a", "c", 0.6, 2), ("c", "e", 0.8, 1)]
    assert rows(S.overlay(vectors, papers.limit(0), 0.99)) == [("a", "a", 1.0, 6)]


def test_field_texts(spark):
    from loomgraph.schemas import CONTENT
    c = spark.createDataFrame([
        ("1", "T1", ["x", "y"], [("A-b", "old"), ("C", "c")], [], "p1", "general", "technique"),
        ("2", "T2", ["z"], [("a B", "new")], [], "p2", "general", "technique"),
        ("3", "long title " * 5, [], [], [], "p3", "general", "survey"),
    ], f"pid string, {CONTENT}")
    got = S.field_texts(c)
    assert rows(got, "key", "label", "define", "problem", "task") == [
        ("a b", "a B", "new", "p2", "z"), ("c", "C", "c", "p1", "x y"),
        ("paper:3", ("long title " * 5)[:30], "long title " * 5, "p3", "")]
    nodes = spark.createDataFrame([("c",)], "key string")
    assert rows(S.field_texts(c, nodes), "key") == [("c",)]
    assert S.long_fields(got).count() == 9


def test_match(spark):
    v = spark.createDataFrame(
        [("concept:b", [1.0, 0.0]), ("concept:a", [2.0, 0.0]), ("concept:z", [0.0, 0.0]), ("concept:n", None),
         ("concept:c", [0.3, math.sqrt(1 - 0.09)]), ("concept:d", [0.2999, math.sqrt(1 - 0.2999 ** 2)]),
         ("paper:p", [1.0, 1.0])], "id string, vec array<double>")
    concepts = R.split_by_type(v, "concept")
    assert [r["id"] for r in R.match(concepts, [3.0, 0.0], floor=0.2999999).collect()] == [
        "concept:a", "concept:b", "concept:c"]
    assert [r["id"] for r in R.match(concepts, [3.0, 0.0], top=1).collect()] == ["concept:a"]
    each = R.match_each(v.withColumn("t", F.substring_index("id", ":", 1)), [1.0, 0.0], "t", top=1)
    assert rows(each, "t", "rank", "id") == [("concept", 1, "concept:a"), ("paper", 1, "paper:p")]


def test_related_terms_and_lines(spark):
    ch = spark.createDataFrame([("concept:a", 0.9), ("concept:x", 0.8), ("concept:b", 0.7)], "id string, score double")
    ph = spark.createDataFrame([("paper:1", 0.95), ("paper:2", 0.5)], "id string, score double")
    concepts = spark.createDataFrame(
        [("concept:a", "A", "d", "ok"), ("concept:b", "B", "d", "placeholder")],
        "id string, canonical string, definition string, def_status string")
    papers = spark.createDataFrame([("paper:1", "", "p"), ("paper:2", "T2", "")], "id string, title string, problem string")
    assert [r["term"] for r in R.related_terms(ch, ph, concepts, papers).collect()] == ["A", "B", "T2"]
    assert [r["term"] for r in R.related_terms(ch, ph, concepts, papers, limit=1).collect()] == ["A"]
    assert rows(R.concept_lines(ch, concepts), "line") == [
        ("- A: d [0.90]",), ("- B (no definition yet) [0.70]",), ("- x (no definition yet) [0.80]",)]
    assert rows(R.paper_lines(ph, papers), "line") == [(" — ".join(["- ", "p [0.95]"]),), ("- T2 — (no problem statement) [0.50]",)]


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])],
                               "a array<double>, b array<double>")
    got = df.select(V.round3(V.cosine("a", "b")).alias("c"), V.unit("a").alias("u")).collect()
    assert [r["c"] for r in got] == [0.96, None, None]
    assert got[0]["u"] == pytest.approx([0.6, 0.8]) and got[1]["u"] is None


def test_store_is_incremental(spark):
    e = HashingEmbedder(8)
    texts = spark.createDataFrame([("concept:a", "x"), ("concept:b", None), ("paper:1", "y"), ("paper:2", " ")],
                                  "id string, text string")
    kept = [0.5] * 8
    store = spark.createDataFrame([(e.model, "concept:a", kept), ("old", "paper:1", kept)],
                                  "model string, id string, vec array<double>")
    got = {r["id"]: r for r in VS.refresh(texts, store, e).collect()}
    assert set(got) == {"concept:a", "paper:1", "paper:2"}
    assert got["concept:a"]["vec"] == kept and got["paper:2"]["vec"] is None
    assert got["paper:1"]["vec"] == pytest.approx(e.embed(["y"])[0])
    forced = {r["id"]: r["vec"] for r in VS.refresh(texts, store, e, force=True).collect()}
    assert forced["concept:a"] == pytest.approx(e.embed(["x"])[0])
    assert rows(VS.summary(store), "model", "type", "n", "dim") == [(e.model, "concept", 1, 8), ("old", "paper", 1, 8)]


def test_embedding_batches(spark):
    class Counting(HashingEmbedder):
        def embed(self, texts):
            assert len(texts) <= 3 and all(t.strip() for t in texts)
            return super().embed(texts)

    df = spark.range(20).select("id", F.when(F.col("id") % 4 > 0, F.concat(F.lit("t"), "id")).alias("text"))
    got = embed_texts(df, Counting(4), batch=3).collect()
    assert len(got) == 20 and sum(r["vec"] is None for r in got) == 5


def test_batch_numbers(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("id"))
    got = VS.batch_numbers(df, 256).collect()
    assert all(r["batch_no"] == r["id"] // 256 for r in got) and len(got) == 1000


def test_text_selection(spark):
    concepts = spark.createDataFrame([("a", "d"), ("b", " ")], "rk string, definition string")
    papers = spark.createDataFrame([("1", "p"), ("2", "")], "pid string, problem string")
    assert rows(VS.v2_texts(concepts, papers)) == [
        ("concept:a", "d"), ("concept:b", None), ("paper:1", "p"), ("paper:2", None)]
    nodes = spark.createDataFrame([("a", "A", "", "survey")], "key string, canonical string, definition string, ptype string")
    assert rows(VS.v1_texts(nodes)) == [("a", "A (survey)")]
    assert VS.fallback_count(nodes).first()[0] == 1


def test_vectors_are_sent_a_fixed_number_of_times(spark):
    """What a join of tiles moves grows with the rows: twice the rows, twice the rows sent; and strips give all pairs."""
    rng = np.random.default_rng(3)
    data = [("f", i, [float(x) for x in rng.normal(size=6)]) for i in range(2400)]
    counts = []
    for n in (1200, 2400):
        distinct = S.distinct_vectors(spark.createDataFrame(data[:n], "field string, id bigint, vec array<double>"))
        counts.append(S._tile_pairs(distinct, S._wide_tile_count(distinct, 64)).count())
    assert counts[1] == 2 * counts[0]
    df = spark.createDataFrame(data, "field string, id bigint, vec array<double>")
    u = np.array([v for _, _, v in data])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    milli = np.rint(u @ u.T * 1000)
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(milli >= 900, 1)))}
    got = [(r["a"], r["b"]) for r in S.pairs(df, 0.9, 64).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("most", [1, 4, 2**26])
def test_products_are_counted_in_place(most):
    """Strips of a histogram are small beside their tile, and copies count exactly however many there are."""
    import pyarrow as pa

    units = S.unit_rows(np.random.default_rng(6).normal(size=(6000, 8)))
    n = np.random.default_rng(7).integers(1, most, 6000, endpoint=True)
    table = pa.table({"lo": [0] * 6000, "hi": [1] * 6000, "right": np.arange(6000) >= 300, "n": n, "vec": pa.array(units.tolist())})
    tracemalloc.start()
    got = S._counted(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = np.zeros(2001, np.int64)
    np.add.at(want, np.rint(S.unit_rows(units)[:300] @ S.unit_rows(units)[300:].T * 1000).astype(int) + 1000, np.outer(n[:300], n[300:]))
    assert (got == want).all()
    assert peak < 10 << 20
