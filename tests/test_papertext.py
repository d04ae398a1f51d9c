import random
from bisect import bisect_left
from itertools import accumulate

from conftest import rows

from loomgraph.operators import papertext as P
from loomgraph.schemas import PAGES


def pages(spark, data):
    return spark.createDataFrame([(p, i, t) for p, ts in data.items() for i, t in enumerate(ts)], PAGES)


def pages_kept(texts, budget):
    """Pages before which the budget is not reached yet, from prefix sums."""
    before = [0, *accumulate(map(len, texts))][:-1]
    return bisect_left(before, budget)


def test_page_budget(spark):
    df = pages(spark, {"p": ["a" * 12000, "b" * 9000, "c" * 5000], "q": ["x", "", "y"], "r": ["z" * 20000, "w"]})
    assert rows(P.leading_pages(df), "paper_id", "page") == [
        ("p", 0), ("p", 1), ("q", 0), ("q", 1), ("q", 2), ("r", 0)]
    got = {r["paper_id"]: r["full"] for r in P.full_texts(df).collect()}
    assert got["p"] == "a" * 12000 + "b" * 9000 and got["q"] == "xy" and got["r"] == "z" * 20000


def test_budget_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(P, "PAGES_PER_BUCKET", 3)
    rnd = random.Random(5)
    data = {f"p{i}": ["x" * rnd.choice([0, 0, 1, 5, 9]) for _ in range(rnd.randint(1, 40))] for i in range(60)}
    df = pages(spark, data)
    got = {r["paper_id"]: r["n"] for r in
           P.leading_pages(df, 50).groupBy("paper_id").count().withColumnRenamed("count", "n").collect()}
    assert got == {p: pages_kept(ts, 50) for p, ts in data.items()}


def test_parsed(spark):
    text = "Title\nAbstract\n" + "x" * 60 + "\n2 Related\nrest"
    df = spark.createDataFrame([("p", text), ("q", "short"), ("r", None)], "paper_id string, full string")
    assert rows(P.parsed(df)) == [
        ("p", True, None, "section", 70, text[6:76]), ("q", True, None, "head6000", 5, "short"),
        ("r", False, "PDF missing", None, None, "")]
