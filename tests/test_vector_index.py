import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from loomgraph.api import Workbench
from loomgraph.operators import retrieval as R, vector_index as VI
from loomgraph.schemas import PAPERS
from loomgraph.session import Scratch, ship_package
from loomgraph.sources.snapshots import Snapshots

RNG = np.random.default_rng(11)


@pytest.fixture(scope="module")
def data(spark):
    """Clustered vectors with a hot copy, zero, null and short vectors."""
    ship_package(spark)
    centres = RNG.normal(size=(12, 24))
    m = centres[RNG.integers(12, size=900)] + RNG.normal(scale=0.35, size=(900, 24))
    m[300:600] = m[300]
    table = [(f"n{i:03d}", v.tolist()) for i, v in enumerate(m)]
    table += [("zero", [0.0] * 24), ("null", None), ("short", [1.0] * 3), ("hole", [None] + [1.0] * 23), ("nan", [float("nan")] * 24)]
    df = spark.createDataFrame(table, "id string, vec array<float>").repartition(4)
    return {k: np.array(v) / np.linalg.norm(v) for k, v in table[:900]}, df


@pytest.fixture(scope="module")
def idx(spark, data):
    return VI.index(data[1], Scratch(spark).write, sample_rows=600, parts=8)


@pytest.fixture(scope="module")
def asked(data):
    return data[1].filter("id like 'n__5'").select(F.col("id").alias("qid"), "vec")


def by_hand(units, qid, top, floor):
    got = sorted((-round(float(units[qid] @ v), 9), k) for k, v in units.items())[:top]
    return [(k, -s) for s, k in got if -s >= floor]


def test_every_row_is_in_one_list(data, idx):
    ids = [r["id"] for r in idx.blocks.select(F.explode("ids").alias("id")).collect()]
    assert sorted(ids) == sorted(data[0])
    for r in idx.blocks.collect():
        m = np.frombuffer(r["vectors"]).reshape(len(r["ids"]), 24)
        assert r["ids"] == sorted(r["ids"]) and np.allclose(m, [data[0][k] for k in r["ids"]], atol=1e-6)
        assert (idx.quantizer.lists_of(m) == r["list"]).all()


@pytest.mark.parametrize("floor", [-1.0, 0.8])
def test_exact_search_is_brute_force(data, idx, asked, floor):
    units = data[0]
    got = {}
    for r in VI.search(idx, asked, top=6, floor=floor, exact=True, bundle=16).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["id"], r["score"]))
    for qid in (r["qid"] for r in asked.collect()):
        want = by_hand(units, qid, 6, floor)
        mine = sorted(got.get(qid, []))
        assert [s for _, _, s in mine] == pytest.approx([s for _, s in want], abs=1e-6)
        assert all(float(units[qid] @ units[k]) == pytest.approx(s, abs=1e-6) for _, k, s in mine)


def test_exact_search_equals_match(data, idx, asked):
    q = asked.filter("qid = 'n005'").first()
    one = VI.search(idx, asked.filter("qid = 'n005'"), exact=True)
    assert rows(one, "rank", "id") == [(i + 1, r["id"]) for i, r in enumerate(R.match(data[1].filter("id like 'n%' and id <> 'nan' and id <> 'null'"), q["vec"]).collect())]


def test_copies_tie_by_id(idx, data):
    hot = data[1].filter("id = 'n300'").select(F.col("id").alias("qid"), "vec")
    for exact in (True, False):
        assert rows(VI.search(idx, hot, top=4, exact=exact), "id")[0] == ("n300",) or not exact
    assert rows(VI.search(idx, hot, top=4, exact=True), "rank", "id") == [(i + 1, f"n30{i}") for i in range(4)]


def test_recall_and_pruning(idx, data, asked):
    found, exact = VI.search(idx, asked), VI.search(idx, asked, exact=True)
    assert VI.recall_of(found, exact).first()["share"] >= 0.9
    q = idx.quantizer
    assert q.probes < len(q.centroids) / 2 and q.depth < 900
    read = VI.candidates(idx, asked, q.probes, q.depth, 16)._jdf.queryExecution().executedPlan().toString()
    assert "codes" in read and "vectors" not in read and "CartesianProduct" not in read and "BroadcastNestedLoop" not in read


def test_small_blocks_long_lists_and_growth(spark, data, asked):
    base = data[1].filter("id < 'n500'")
    q = VI.fit(base, lists=5, parts=5, sample_rows=200)
    old, new = VI.build(base, q, block_rows=16), VI.build(data[1].filter("id >= 'n500'"), q, block_rows=16)
    scratch = Scratch(spark)
    grown = VI.VectorIndex(q, scratch.write("old", old).unionByName(scratch.write("new", new)))
    whole = VI.VectorIndex(q, scratch.write("whole", VI.build(data[1], q)))
    assert grown.blocks.filter(F.size("ids") > 16).isEmpty()
    for top in (3, 40):
        assert rows(VI.search(grown, asked, top, exact=True), "qid", "rank", "id") == rows(VI.search(whole, asked, top, exact=True), "qid", "rank", "id")


def test_quantizer_is_stored_and_read(spark, idx):
    q = VI.Quantizer.from_frame(idx.quantizer.to_frame(spark))
    assert (q.centroids == idx.quantizer.centroids).all() and (q.books == idx.quantizer.books).all()
    assert (q.probes, q.depth) == (idx.quantizer.probes, idx.quantizer.depth)


def test_nothing_to_index(spark, idx, asked):
    none = spark.createDataFrame([], "id string, vec array<float>")
    with pytest.raises(ValueError):
        VI.fit(none)
    assert VI.search(idx, asked.filter("false")).count() == 0
    empty = VI.VectorIndex(idx.quantizer, Scratch(spark).write("none", VI.build(none, idx.quantizer)))
    assert VI.search(empty, asked).count() == 0 and VI.search(empty, asked, exact=True).count() == 0


def test_index_in_a_store(spark, data, asked, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    named = data[1].select(F.lit("m").alias("model"), F.concat(F.lit("concept:"), "id").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    store.write("vectors", named.unionByName(named.limit(5).withColumn("id", F.concat(F.lit("paper:"), "id"))))
    bench = Workbench(spark, str(tmp_path))
    bench.index_vectors("concept", sample_rows=400, parts=8)
    found, exact = (bench.match_many(asked, "concept", exact=e) for e in (False, True))
    assert VI.recall_of(found, exact).first()["share"] >= 0.9
    assert exact.filter("not id like 'concept:%'").isEmpty() and exact.filter("rank = 1").count() == asked.count()


def test_sample_of_papers(spark, tmp_path):
    Snapshots(spark, str(tmp_path)).write("papers", spark.createDataFrame([(str(i), None, None, None, None, None) for i in range(9)], PAPERS))
    assert rows(Workbench(spark, str(tmp_path)).sample(), "pid") == [("0",), ("1",), ("2",)]
