import pytest
from conftest import rows
from pyspark.sql import functions as F

from loomgraph.operators import lexicon as L
from loomgraph.schemas import LEXICON


def lex(spark, *items):
    """(name, aliases, status[, definition[, source]]) in order."""
    data = []
    for i, it in enumerate(items):
        it = list(it) + ["approved", "", ""][len(it) - 2:]
        data.append((i, it[0], it[1], it[2], it[3], it[4], ""))
    return spark.createDataFrame(data, LEXICON)


def names(spark, *ns):
    return spark.createDataFrame([(n,) for n in ns], "name string")


@pytest.mark.parametrize("order, rk", [
    ([("X", ["y"]), ("Y", [])], "y"),
    ([("Y", []), ("X", ["y"])], "x"),
])
def test_last_writer_wins(spark, order, rk):
    assert rows(L.resolve(names(spark, "y"), lex(spark, *order)), "rk") == [(rk,)]


def test_resolve_labels(spark):
    lx = lex(spark, ("Graph-RAG", ["GR", "g r"], "approved", "d"), ("Other", [], "rejected"))
    got = L.resolve(names(spark, "graph rag", "gr", "G-R", "new-Name"), lx)
    assert rows(got, "name", "rk", "label", "status", "found") == [
        ("G-R", "graph rag", "Graph-RAG", "approved", True),
        ("gr", "graph rag", "Graph-RAG", "approved", True),
        ("graph rag", "graph rag", "Graph-RAG", "approved", True),
        ("new-Name", "new name", "new-Name", None, False),
    ]


def test_two_spellings_of_one_name(spark):
    lx = lex(spark, ("A B", [], "approved", "first"), ("a-b", [], "pending", "last"))
    assert rows(L.names_lookup(lx)) == [("a b", "a b", "a-b", "pending", "last")]


def test_sorting(spark):
    lx = lex(spark, ("b", [], "approved", "", "Zed"), ("A", [], "pending", "", None), ("c", [], "pending", "", "alpha"))
    assert [r["name"] for r in L.sorted_by(lx, "source").collect()] == ["A", "c", "b"]
    assert [r["name"] for r in L.sorted_by(lx, "name", "desc").collect()] == ["c", "b", "A"]
    assert [r["name"] for r in L.sorted_by(lx, "status").collect()] == ["b", "A", "c"]
    assert rows(L.status_counts(lx)) == [("approved", 1), ("pending", 2)]
    assert rows(L.with_status(lx, "pending"), "name") == [("A",), ("c",)]
    assert rows(L.highlighted(lx, " B "), "name", "matched") == [("A", False), ("b", True), ("c", False)]
    with pytest.raises(L.LexiconError):
        L.sorted_by(lx, "definition")


def test_patch(spark):
    lx = lex(spark, ("A", ["x"], "pending"), ("B", [], "pending"))
    out = L.patch(lx, "A", {"status": "approved", "aliases": ["p", "q"], "name": "no", "extra": 1})
    assert rows(out, "name", "status", "aliases") == [("A", "approved", ["p", "q"]), ("B", "pending", [])]
    with pytest.raises(L.LexiconError) as e:
        L.patch(lx, "a", {"status": "approved"})
    assert e.value.kind == "not_found"


def test_merge(spark):
    lx = lex(spark, ("S", ["p", "q"]), ("D", ["q"]), ("T", ["D", "t"]))
    assert rows(L.merge(lx, "S", "D"), "name", "aliases") == [("D", ["q", "S", "p"]), ("T", ["D", "t"])]
    assert rows(L.merge(lx, "T", "D"), "name", "aliases") == [("D", ["q", "T", "t"]), ("S", ["p", "q"])]
    kept = lex(spark, ("S", ["q"]), ("D", ["q", "q"]))
    assert rows(L.merge(kept, "S", "D"), "aliases") == [(["q", "q", "S"],)]
    for args, kind in ((("S", "S"), "bad_request"), (("", "D"), "bad_request"),
                       (("S", "Z"), "not_found"), (("Z", "D"), "not_found")):
        with pytest.raises(L.LexiconError) as e:
            L.merge(lx, *args)
        assert e.value.kind == kind


def merges(spark, *items):
    return spark.createDataFrame(list(items), "src string, dst string, seq bigint")


def test_merge_chains(spark):
    lx = lex(spark, ("A", ["a1"]), ("B", ["b1"]), ("C", ["c1", "c1"]), ("E", ["b1", "C", "e1"]), ("F", []))
    chain = merges(spark, ("A", "B", 1), ("B", "C", 2), ("E", "C", 3), ("F", "gone", 4), ("zz", "A", 5))
    assert rows(L.merge_many(lx, chain), "name", "aliases") == [("C", ["c1", "c1", "B", "b1", "A", "a1", "E", "e1"]), ("F", [])]
    assert rows(L.merged_aliases(lx, chain)) == [
        ("C", i, a) for i, a in enumerate(["c1", "c1", "B", "b1", "A", "a1", "E", "e1"])]
    first = merges(spark, ("A", "B", 1), ("A", "C", 2))
    assert rows(L.merge_many(lx, first), "name", "aliases")[:2] == [("B", ["b1", "A", "a1"]), ("C", ["c1", "c1"])]
    with pytest.raises(L.LexiconError, match="circle"):
        L.merge_many(lx, merges(spark, ("F", "A", 0), ("A", "B", 1), ("B", "C", 2), ("C", "A", 3)))


def test_patches_of_one_name_apply_in_order(spark):
    lx = lex(spark, ("A", ["x"], "pending"), ("B", [], "pending"))
    p = spark.createDataFrame([("A", 2, "rejected", None), ("A", 1, "approved", "old"), ("A", 3, None, "new")],
                              "name string, seq int, status string, definition string")
    assert rows(L.patch_many(lx, p), "name", "status", "definition") == [("A", "rejected", "new"), ("B", "pending", "")]


def test_merge_keeps_names_resolvable(spark):
    lx = lex(spark, ("S", ["p"]), ("D", []))
    got = L.resolve(names(spark, "s", "p", "d"), L.merge(lx, "S", "D"))
    assert rows(got, "name", "rk") == [("d", "d"), ("p", "d"), ("s", "d")]


def plan(spark, *items):
    return spark.createDataFrame(list(items), "name string, action string, into string")


def test_bulk_classify(spark):
    lx = lex(spark, ("A", [], "pending"), ("B", [], "pending"), ("C", ["c1"], "pending"), ("D", [], "approved"))
    good = plan(spark, ("A", "approve", None), ("B", "reject", None), ("C", "merge", "D"))
    assert rows(L.bulk_classify(lx, good, apply=True), "name", "status", "aliases") == [
        ("A", "approved", []), ("B", "rejected", []), ("D", "approved", ["C", "c1"])]
    assert rows(L.bulk_classify(lx, good)) == rows(lx)
    short = plan(spark, ("A", "approve", None), ("D", "reject", None), ("Z", "reject", None))
    check = L.check_plan(lx, short)
    assert rows(check.missing) == [("Z",)]
    assert rows(check.unplanned) == [("B",), ("C",)]
    assert rows(check.not_pending) == [("D",)]
    with pytest.raises(L.LexiconError):
        L.bulk_classify(lx, short, apply=True)


def test_bulk_classify_of_settled_rows(spark):
    lx = lex(spark, ("A", [], "approved"))
    p = plan(spark, ("A", "reject", None))
    assert rows(L.bulk_classify(lx, p, apply=True), "status") == [("rejected",)]
    assert rows(L.bulk_classify(lx, p, apply=True, skip_non_pending=True), "status") == [("approved",)]


def test_alias_edit(spark):
    df = spark.createDataFrame([(["a", "b"],)], "al array<string>")
    got = df.select(
        L.add_alias(F.col("al"), F.lit(" c ")).alias("x"), L.add_alias(F.col("al"), F.lit(" a ")).alias("y"),
        L.add_alias(F.col("al"), F.lit("  ")).alias("z"), L.remove_alias(F.col("al"), F.lit("a")).alias("w"),
    ).first()
    assert (got["x"], got["y"], got["z"], got["w"]) == (["a", "b", "c"], ["a", "b"], ["a", "b"], ["b"])
