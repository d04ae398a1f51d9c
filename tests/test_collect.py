import pytest
from conftest import rows
from pyspark.sql import functions as F

from loomgraph.external import KeywordClassifier
from loomgraph.operators import collect as C
from loomgraph.schemas import FEED, LEDGER

META = ("title", "abstract", "published", ["c"])


def ledger(spark, *items):
    """(aid, gate or None, extracted)."""
    return spark.createDataFrame([(a, *META, g, x, "seed") for a, g, x in items], LEDGER)


def gate(verdict, ver="gate-v1"):
    return (verdict, "r", "m", ver, "2024-01-01")


def feed(spark, *items):
    """(query_ord, entry_ord, id, published)."""
    return spark.createDataFrame(
        [(q, f"q{q}", e, i, f" title  of {i} ", "s\nt", p, [("cs.CL",)]) for q, e, i, p in items], FEED)


def test_dedup_queries(spark):
    q = spark.createDataFrame([(0, " RAG "), (1, "rag"), (2, ""), (3, None), (4, "Graph"), (5, "\t")], "ord int, query string")
    assert rows(C.dedup_queries(q)) == [(0, "RAG"), (4, "Graph")]


def test_search_results(spark):
    f = feed(spark,
             (0, 0, "http://x/abs/1v1", "2024-05-01T00:00:00Z"), (0, 1, "http://x/abs/2v3", "2024-03-01T00:00:00Z"),
             (1, 0, "http://x/abs/2v1", "2024-06-01T00:00:00Z"), (1, 1, "3", ""), (1, 2, "4", "2023-12-31"),
             (1, 3, "", "2024-05-01"))
    got = C.search_results(f, "2024-03", "2024-05")
    assert rows(got, "aid", "first_seen_query", "published", "title", "abstract", "categories") == [
        ("1", "q0", "2024-05-01", "title of http://x/abs/1v1", "s t", ["cs.CL"]),
        ("2", "q0", "2024-03-01", "title of http://x/abs/2v3", "s t", ["cs.CL"]),
        ("3", "q1", "", "title of 3", "s t", ["cs.CL"])]
    # an entry outside the period does not claim its id for the query
    late = C.search_results(f, "2024-06", "")
    assert rows(late, "aid", "first_seen_query") == [("2", "q1"), ("3", "q1")]
    # the per-query limit comes before the period filter
    assert rows(C.search_results(f, limit=1), "aid") == [("1",), ("2",)]


def test_funnel(spark):
    found = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "aid string")
    owned = spark.createDataFrame([("1",), ("1",), ("9",)], "aid string")
    lg = ledger(spark, ("1", gate("reject"), False), ("2", gate("Dropped"), False), ("3", gate("DROP"), False), ("4", None, False))
    j = C.judged(found, owned, lg)
    assert C.funnel(j).first().asDict() == {"found": 4, "owned_excluded": 1, "gate_excluded": 1, "new": 2}
    assert rows(C.new_candidates(j)) == [("2",), ("4",)]
    assert C.funnel(C.judged(found, owned, lg, reject=("dropped",))).first()["gate_excluded"] == 1


def test_upsert(spark):
    lg = ledger(spark, ("1", gate("technique"), True), ("2", None, False))
    f = C.search_results(feed(spark, (0, 0, "1", "2025-01-01"), (0, 1, "3", "2025-01-02")))
    got = {r["aid"]: r for r in C.upsert_ledger(lg, f).collect()}
    assert got["1"]["title"] == "title of 1" and got["1"]["gate"]["verdict"] == "technique"
    assert got["1"]["extracted"] and got["1"]["first_seen_query"] == "seed"
    assert got["2"]["title"] == "title"
    assert got["3"]["gate"] is None and got["3"]["extracted"] is False and got["3"]["first_seen_query"] == "q0"
    again = C.upsert_ledger(C.upsert_ledger(lg, f), f)
    assert rows(again) == rows(C.upsert_ledger(lg, f))
    done = C.mark_extracted(lg, spark.createDataFrame([("2",)], "aid string"))
    assert rows(done, "aid", "extracted") == [("1", True), ("2", True)]


def test_gate_cache(spark):
    class Recording(KeywordClassifier):
        def classify(self, papers):
            self.asked = [r["aid"] for r in papers.collect()]
            return super().classify(papers)

    lg = ledger(spark, ("1", gate("survey"), False), ("2", gate("survey", "gate-v0"), False), ("3", None, False), ("4", None, False))
    lg = lg.withColumn("title", F.when(F.col("aid") == "3", "A Benchmark suite").otherwise("plain"))
    judge = Recording()
    asked = spark.createDataFrame([("1",), ("2",), ("3",)], "aid string")
    out = C.run_gate(lg, asked, judge, "gate-v1", "2024-06-01")
    assert sorted(judge.asked) == ["2", "3"]
    assert rows(out.results) == [("1", "survey", False, True), ("2", "technique", True, False), ("3", "benchmark", False, False)]
    assert C.gate_funnel(out.results).first().asDict() == {"judged": 3, "passed": 1, "calls": 2, "cache_hits": 1}
    got = {r["aid"]: r["gate"] for r in out.ledger.collect()}
    assert got["1"]["model"] == "m" and got["4"] is None
    assert got["2"].asDict() == {"verdict": "technique", "reason": "no keyword", "model": "keyword-rules",
                                 "prompt_ver": "gate-v1", "date": "2024-06-01"}
    assert got["3"]["reason"] == "mentions benchmark"


@pytest.mark.parametrize("data, want", [
    ([("t", "a", "p"), ("t", "a", "")], (2, 1, True)),
    ([("t", "a", "p"), ("t", None, "p"), ("", "a", "p")], (3, 1, False)),
])
def test_completeness(spark, data, want):
    df = spark.createDataFrame(data, "title string, abstract string, published string")
    assert tuple(C.completeness(df).first()) == want
