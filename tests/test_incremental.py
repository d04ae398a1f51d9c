"""A rebuild by deltas against a full rebuild, on random splits."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from loomgraph.api import Workbench
from loomgraph.operators import view
from loomgraph.plans import incremental
from loomgraph.plans.rebuild import rebuild
from loomgraph.schemas import LEXICON, MENTIONS, PAPERS
from loomgraph.sources.snapshots import Snapshots

NAMES = ["A", "a-b", "B", "C c", "d", "E", "f", "G", "gone", "kept"]


def world(spark, seed, n=24):
    rng = random.Random(seed)
    papers, mentions = [], []
    for i in rng.sample(range(100), n):
        pid = f"24{i % 12 + 1:02d}.{i:03d}"
        papers.append((pid, rng.choice([None, f"T{i}"]), rng.choice(["", "p"]), rng.choice([None, ["t"]]),
                       rng.choice([None, "", "medical"]), rng.choice([None, "", "survey", "technique"])))
        for pos in range(rng.choice([0, 1, 2])):
            mentions.append((pid, 0, pos, rng.choice(NAMES), rng.choice(["", f"def {pid}"])))
        for pos in range(rng.choice([0, 1, 3])):
            mentions.append((pid, 1, pos, rng.choice(NAMES), ""))
    lexicon = [(0, "A", ["alpha", "a b"], "approved", "given", "", ""), (1, "gone", [], "rejected", "", "", ""), (2, "kept", ["f"], "pending", "x", "", "")]
    return (spark.createDataFrame(papers, PAPERS).repartition(2), spark.createDataFrame(mentions, MENTIONS).repartition(2),
            spark.createDataFrame(lexicon, LEXICON))


LEX = ("name", "aliases", "status", "definition", "source", "first_seen")


def assert_same(store, full):
    assert rows(store.read("lexicon"), *LEX) == rows(full.lexicon, *LEX)
    v1, v2 = full.v1, full.v2
    for name, want in (("v1_nodes", v1.nodes), ("v1_node_papers", v1.node_papers), ("v1_edges", v1.edges), ("v2_papers", v2.papers),
                       ("v2_concepts", v2.concepts), ("v2_edges", v2.edges), ("view_nodes", view.concepts(v2)), ("view_builds_on", view.builds_on(v2))):
        assert rows(store.read(name), *want.columns) == rows(want), name


@pytest.mark.parametrize("seed", [1])
def test_deltas_equal_a_full_rebuild(spark, tmp_path, seed):
    papers, mentions, lexicon = world(spark, seed)
    store = Snapshots(spark, str(tmp_path))
    part = F.pmod(F.xxhash64("pid", F.lit(seed)), F.lit(3))
    for k in range(3):
        incremental.apply(store, papers.filter(part == k), mentions.filter(part == k), lexicon if k == 0 else store.read("lexicon"), full=k == 0, buckets=2)
    assert_same(store, rebuild(papers, mentions, lexicon))


def test_a_pending_name_is_registered_anew(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    lexicon = spark.createDataFrame([], LEXICON)
    papers = spark.createDataFrame([(p, "T", "", [], "general", "technique") for p in ("2401.1", "2402.1", "2403.1")], PAPERS)
    mentions = spark.createDataFrame([("2402.1", 0, 0, "Home", "h"), ("2402.1", 1, 0, "late name", ""), ("2403.1", 1, 0, "Late-Name", ""),
                                      ("2401.1", 0, 0, "LATE name", "now defined")], MENTIONS)
    old = F.col("pid") != "2401.1"
    incremental.apply(store, papers.filter(old), mentions.filter(old), lexicon, full=True, buckets=4)
    assert rows(store.read("v1_edges")) == [] and rows(store.read("lexicon"), "ord", "name", "status") == [(0, "Home", "unreviewed"), (1, "late name", "pending")]
    incremental.apply(store, papers.filter(~old), mentions.filter(~old), store.read("lexicon"), full=False)
    assert rows(store.read("lexicon"), "ord", "name", "status", "definition") == [(0, "Home", "unreviewed", "h"), (1, "LATE name", "unreviewed", "now defined")]
    assert rows(store.read("v1_edges")) == [("home", "late name"), ("paper:2403.1", "late name")]
    assert_same(store, rebuild(papers, mentions, lexicon))


def test_cost_follows_the_delta(spark, tmp_path):
    papers, mentions, lexicon = world(spark, 5, 60)
    store = Snapshots(spark, str(tmp_path))
    last = papers.agg(F.max("pid")).first()[0]
    old = F.col("pid") != last
    incremental.apply(store, papers.filter(old), mentions.filter(old), lexicon, full=True, buckets=16)
    before = {n: store.version(n).folders for n in ("v2_papers", "inc_homes", "inc_firsts", "v1_nodes")}
    incremental.apply(store, papers.filter(~old), mentions.filter(~old), store.read("lexicon"), full=False)
    assert_same(store, rebuild(papers, mentions, lexicon))
    touched = mentions.filter(~old).count() + 1
    for name, folders in before.items():
        now = store.version(name).folders
        assert sum(now.get(b) != p for b, p in folders.items()) <= touched, name


def test_workbench_follows_until_the_lexicon_is_edited(spark, tmp_path):
    papers, mentions, lexicon = world(spark, 7)
    store = Snapshots(spark, str(tmp_path))
    half = F.pmod(F.xxhash64("pid"), F.lit(2)) == 0
    store.write("lexicon", lexicon)
    bench = Workbench(spark, str(tmp_path))

    def grow(which):
        with store.commit() as c:
            c.replace("papers", papers.filter(which), papers.filter(which), "pid", PAPERS, 4)
            c.replace("mentions", papers.filter(which), mentions.filter(which), "pid", MENTIONS, 4)

    grow(half)
    assert not incremental.rebuild_stored(store)
    grow(~half)
    assert incremental.can_follow(store, store.read("lexicon"))
    out = bench.rebuild()
    full = rebuild(papers, mentions, lexicon)
    assert out == {"ok": True, **full.counts().first().asDict()}
    assert_same(store, full)
    bench.patch_lexicon("A", {"status": "rejected"})
    edited = store.read("lexicon")
    assert not incremental.rebuild_stored(store)
    assert_same(store, rebuild(papers, mentions, edited))
    with store.commit() as c:
        incremental.invalidate(c)
    assert not incremental.can_follow(store, store.read("lexicon"))


def test_only_mentions_that_may_be_looked_up_are_kept(spark, tmp_path):
    papers, mentions, lexicon = world(spark, 3, 40)
    store = Snapshots(spark, str(tmp_path))
    incremental.apply(store, papers, mentions, lexicon, full=True, buckets=2)
    pending = store.read("inc_registered").filter("status = 'pending'").select("rk")
    assert store.read("inc_rows").join(pending, "rk", "left_anti").isEmpty()
