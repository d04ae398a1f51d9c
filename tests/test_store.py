"""Commits of several tables, bucketed upserts, crashes between any two writes, and cleaning up."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from loomgraph.operators import collect as C
from loomgraph.plans.extraction import add_records
from loomgraph.schemas import CONTENT, LEDGER
from loomgraph.sources.snapshots import Snapshots, bucket_of

KV = "k string, v bigint"


def kv(spark, *pairs):
    return spark.createDataFrame(list(pairs), KV)


def union(old, delta):
    return old.unionByName(delta)


def latest(old, delta):
    return delta.unionByName(old.join(delta.select("k"), "k", "left_anti"))


class Crash(Exception):
    pass


def test_an_upsert_writes_only_its_buckets(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path))
    assert s.upsert("t", kv(spark, *[(f"k{i}", i) for i in range(200)]), "k", union, KV, 16) == 16
    before = s.version("t").folders
    delta = kv(spark, ("k3", -3), ("new", 1))
    touched = {r[0] for r in delta.select(bucket_of("k", 16)).collect()}
    for _ in range(2):  # the second is a replay
        assert s.upsert("t", delta, "k", latest, KV) == len(touched) <= 2
        now = s.version("t").folders
        assert all((now[b] == p) != (b in touched) for b, p in before.items())
        assert s.read("t").count() == 201 and rows(s.read("t").filter("k in ('k3', 'new')")) == [("k3", -3), ("new", 1)]
    assert s.version("t").number == 3
    plan = s.read("t").filter("k = 'k3'")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(k), EqualTo(k,k3)]" in plan


def test_buckets_may_empty_and_fill_again(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path))
    s.upsert("t", kv(spark, ("a", 1), ("b", 2)), "k", union, KV, 4)
    with s.commit() as c:
        c.replace("t", kv(spark, ("a", 0), ("b", 0)), kv(spark), "k", KV)
    assert s.exists("t") and rows(s.read("t")) == [] and s.read("t").columns == ["k", "v"]
    s.upsert("t", kv(spark), "k", union, KV)
    s.upsert("t", kv(spark, ("c", 3)), "k", union, KV)
    assert rows(s.read("t")) == [("c", 3)] and rows(s.lookup("t", kv(spark, ("c", 0), ("x", 0)), "k")) == [("c", 3)]


def test_a_plain_table_is_dealt_into_buckets(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path))
    s.write("t", kv(spark, ("a", 1), ("b", 2), ("c", 3)))
    s.upsert("t", kv(spark, ("b", 5)), "k", latest, KV, 4)
    assert rows(s.read("t")) == [("a", 1), ("b", 5), ("c", 3)] and s.version("t").buckets == 4
    s.write("t", s.read("t").filter("v > 1"))
    assert rows(s.read("t")) == [("b", 5), ("c", 3)] and s.version("t").buckets is None


def test_tables_of_a_commit_change_together(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path))
    s.write("x", kv(spark, ("a", 1)))
    with pytest.raises(Crash), s.commit() as c:
        c.write("x", kv(spark, ("a", 2)))
        c.upsert("y", kv(spark, ("b", 2)), "k", union, KV)
        raise Crash
    assert rows(s.read("x")) == [("a", 1)] and not s.exists("y")
    with s.commit() as c:
        c.write("x", kv(spark, ("a", 3)))
        c.upsert("y", kv(spark, ("b", 3)), "k", union, KV)
    assert rows(s.read("x")) == [("a", 3)] and rows(s.read("y")) == [("b", 3)]


def test_half_written_folders_are_in_nobodys_way(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path))
    s.write("t", kv(spark, ("a", 1)))

    def bad(old, delta):
        return delta.withColumn("v", F.raise_error(F.lit("lost")).cast("bigint"))

    with pytest.raises(Exception, match="lost"):
        s.upsert("t", kv(spark, ("b", 2)), "k", bad, KV)
    (tmp_path / "t" / "left-over").mkdir()
    s.write("t", kv(spark, ("c", 3)))
    assert rows(s.read("t")) == [("c", 3)]


def test_vacuum_keeps_what_is_current(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path))
    s.write("x", kv(spark, ("a", 1)))
    s.write("x", kv(spark, ("a", 2)))
    s.upsert("y", kv(spark, *[(f"k{i}", i) for i in range(20)]), "k", union, KV, 4)
    s.upsert("y", kv(spark, ("k1", 9)), "k", latest, KV)
    (tmp_path / "x" / "left-over").mkdir()
    assert s.vacuum(hours=1) == []
    want = rows(s.read("x")), rows(s.read("y"))
    gone = s.vacuum(hours=-1)
    assert len(gone) == 3 and (rows(s.read("x")), rows(s.read("y"))) == want
    assert len(list((tmp_path / "x").iterdir())) == 1 and len(list((tmp_path / "_pointers").glob("*.json"))) == 1
    assert s.vacuum(hours=-1) == [] and s.version("y").number == 2


def records(spark, *pids):
    contents = spark.createDataFrame([(p, f"T{p}", [], [(f"N{p}", "d")], [], "", "general", "technique") for p in pids], f"pid string, {CONTENT}")
    return contents, spark.createDataFrame([(p, ["N1"]) for p in pids], "pid string, builds_on array<string>")


@pytest.mark.parametrize("crash", ["papers", "mentions", "pointers"])
def test_no_record_is_lost_when_adding_dies(spark, tmp_path, monkeypatch, crash):
    s = Snapshots(spark, str(tmp_path))
    add_records(s, *records(spark, "1"))

    def fail(*_, **__):
        raise Crash

    with monkeypatch.context() as m:
        if crash == "pointers":
            m.setattr(Snapshots, "_point", fail)
        else:
            from loomgraph.sources.snapshots import Commit
            whole = Commit.replace
            m.setattr(Commit, "replace", lambda self, name, *a, **k: fail() if name == crash else whole(self, name, *a, **k))
        with pytest.raises(Crash):
            add_records(s, *records(spark, "1", "2", "3"))
    assert rows(s.read("papers"), "pid") == [("1",)] and s.read("mentions").count() == 2
    add_records(s, *records(spark, "1", "2", "3"))
    assert rows(s.read("papers"), "pid") == [("1",), ("2",), ("3",)] and s.read("mentions").count() == 6


def test_of_several_records_of_a_paper_one_is_chosen_alike(spark, tmp_path):
    contents, lineage = records(spark, "1")
    more = contents.withColumn("title", F.lit("A first"))
    for k, c in enumerate((contents.unionByName(more), more.unionByName(contents).repartition(3))):
        s = Snapshots(spark, str(tmp_path / str(k)))
        add_records(s, c, lineage.unionByName(lineage))
        assert rows(s.read("papers"), "title") == [("A first",)] and s.read("mentions").count() == 2


def test_ledger_batches(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path))
    found = spark.createDataFrame([(f"24.{i}", f"T{i}", "a", "2024", ["c"], "q") for i in range(40)],
                                  "aid string, title string, abstract string, published string, categories array<string>, first_seen_query string")
    s.upsert("ledger", found, "aid", C.upsert_ledger, LEDGER, 32)
    one = found.filter("aid = '24.7'").withColumn("title", F.lit("new title")).withColumn("first_seen_query", F.lit("other"))
    for _ in range(2):
        assert s.upsert("ledger", one, "aid", C.upsert_ledger, LEDGER) == 1
        assert rows(s.read("ledger").filter("aid = '24.7'"), "title", "first_seen_query", "extracted") == [("new title", "q", False)]
        assert s.read("ledger").count() == 40


def test_appended_rows_leave_stored_ones_alone(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path))
    s.upsert("t", kv(spark, *[(f"k{i}", i) for i in range(40)]), "k", union, KV, 4)
    before = s.version("t").folders
    for i in range(2):
        with s.commit() as c:
            c.append("t", kv(spark, ("k1", -1 - i)), "k", KV)
    now = s.version("t").folders
    assert all(set(p) <= set(now[b]) for b, p in before.items()) and sorted(len(p) for p in now.values()) == [1, 1, 1, 3]
    assert rows(s.read("t").filter("k = 'k1'"), "v") == [(-1,), (-2,), (1,)] and s.read("t").count() == 42
    assert rows(s.lookup("t", kv(spark, ("k1", 0)), "k"), "v") == [(-1,), (-2,), (1,)]
    s.upsert("t", kv(spark, ("k1", 9)), "k", latest, KV)
    assert rows(s.read("t").filter("k = 'k1'"), "v") == [(9,)] and s.vacuum(hours=-1) and s.read("t").count() == 40
