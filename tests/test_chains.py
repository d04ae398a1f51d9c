"""Chains of merges against a plain walk."""

import random

import pytest
from conftest import rows
from test_lexicon import lex, merges

from loomgraph.operators import chains, lexicon as L
from loomgraph.session import materialize


def walked(steps):
    """src -> (root, place) by recursion-free depth-first walks."""
    kids, parent = {}, {s: d for s, d, _ in steps}
    for s, d, q in steps:
        kids.setdefault(d, []).append((q, s))
    out = {}
    for root in set(kids) - set(parent):
        stack, n = sorted(kids[root], reverse=True), 0
        while stack:
            _, s = stack.pop()
            out[s] = (root, n)
            n += 1
            stack += sorted(kids.get(s, []), reverse=True)
    return out


def frame(spark, steps):
    return materialize(spark.createDataFrame(steps, "src string, dst string, seq bigint").repartition(3))


def answer(spark, steps):
    step = frame(spark, steps)
    return {r["src"]: (r["root"], r["place"]) for r in chains.chain_ends(step).join(chains.walk_places(step), "src").collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i:03d}" for i in range(120)]
    steps = [(names[i], names[rng.randrange(max(0, i - (120 if seed == 1 else rng.choice([1, 2, 2, 9]))), i)], rng.randrange(6)) for i in range(1, 120) if rng.random() < (0.9 if seed == 1 else 0.99)]
    assert answer(spark, steps) == walked(steps)
    step = frame(spark, steps)
    assert (chains.short_chains(step) is None) == (seed == 2)
    assert {r["src"]: (r["root"], r["place"]) for r in chains.ends_and_places(step).collect()} == walked(steps)


def test_a_star_has_no_stations(spark):
    steps = [(f"s{i}", "hub", i % 3) for i in range(50)]
    assert answer(spark, steps) == walked(steps)


def test_a_long_chain_takes_logarithmic_rounds(spark, monkeypatch):
    rounds = []

    def counting(df):
        rounds.append(1)
        return materialize(df)

    monkeypatch.setattr(chains, "materialize", counting)
    n = 10_000
    steps = [(f"c{i:05d}", f"c{i + 1:05d}", 0) for i in range(n)]
    got = answer(spark, steps)
    assert got["c00000"] == ("c10000", n - 1) and got["c09999"] == ("c10000", 0) and len(rounds) <= 2 * 16 + 3


def test_circles_end(spark):
    for steps in ([("a", "b", 0), ("b", "a", 0)], [("x", "y", 0), ("y", "z", 0), ("z", "x", 0), ("w", "x", 1)]):
        with pytest.raises(chains.Circle):
            chains.chain_ends(frame(spark, steps))


def test_outcome_of_a_plan_is_that_of_applying_it(spark):
    lx = lex(spark, ("A", ["a1", "x"], "pending"), ("B", [], "pending"), ("C", ["c1", "x"], "pending"), ("D", ["x"], "approved"), ("E", [], "pending"))
    plan = spark.createDataFrame([("A", "merge", "D"), ("C", "merge", "A"), ("B", "reject", None), ("E", "approve", None)], "name string, action string, into string")
    done = L.apply_plan(lx, plan).selectExpr("status", "size(aliases) as n").groupBy("status").agg({"*": "count", "n": "sum"})
    out = L.plan_outcome(lx, plan)
    assert rows(out, "status", "n", "n_aliases") == rows(done, "status", "count(1)", "sum(n)") == [("approved", 2, 5), ("rejected", 1, 0)]
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString() and merges
