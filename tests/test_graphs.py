"""Graph building on hand-made records."""

import pytest
from conftest import rows
from test_lexicon import lex

from loomgraph.operators import graph_v1, graph_v2, lexicon as L, mentions as M, view
from loomgraph.plans.rebuild import rebuild
from loomgraph.schemas import CONTENT, LINEAGE
from loomgraph.sources.snapshots import Snapshots


class World:
    """papers: pid -> (defines [(name, definition)], builds_on [..], overrides)."""

    def __init__(self, spark, lexicon, papers):
        contents, lineage = [], []
        for pid, (defines, builds, *more) in papers.items():
            m = {"title": f"title {pid}", "problem": f"problem {pid}", "domain": "general",
                 "paper_type": "technique", **(more[0] if more else {})}
            if not m.get("no_content"):
                contents.append((pid, m["title"], ["t"], defines, [], m["problem"], m["domain"], m["paper_type"]))
            lineage.append((pid, builds))
        self.contents = spark.createDataFrame(contents, f"pid string, {CONTENT}")
        self.mentions = M.from_records(self.contents, spark.createDataFrame(lineage, f"pid string, {LINEAGE}"))
        self.papers = M.papers_of(self.contents)
        self.lexicon = lexicon

    @property
    def v1(self):
        return graph_v1.build(self.papers, self.mentions, self.lexicon)

    @property
    def v2(self):
        return graph_v2.build(self.papers, self.mentions, self.lexicon)


EMPTY = ()


def test_unknown_name_built_then_defined(spark):
    w = World(spark, lex(spark, ("Z", [])), {"1": ([], ["N"]), "2": ([("N", "d")], [])})
    assert rows(w.v1.registered, "rk", "status", "definition", "first_seen") == [("n", "unreviewed", "d", "2")]
    assert ("n",) in rows(w.v1.nodes, "key")
    assert rows(w.v2.registered, "rk", "status", "definition", "first_seen") == [("n", "pending", "", "1")]
    assert rows(w.v2.concepts) == []
    after = rebuild(w.papers, w.mentions, w.lexicon)
    assert rows(after.v2.registered) == []
    assert rows(after.v2.concepts, "rk", "status") == [("n", "unreviewed")]
    assert rows(after.v2.edges, "pid", "type", "rk") == [("1", "builds_on", "n"), ("2", "defines", "n")]


def test_definitions(spark):
    w = World(spark, lex(spark, ("Z", []), ("K", [], "approved", "from lexicon")),
              {"1": ([("N", "")], []), "2": ([("N", "d"), ("K", "")], [])})
    assert rows(w.v1.nodes.filter("key in ('n', 'k')"), "key", "definition", "def_source") == [
        ("k", "from lexicon", "2"), ("n", "", "1")]
    assert rows(w.v2.concepts, "rk", "definition", "def_status") == [("k", "", "ok"), ("n", "d", "ok")]


def test_placeholder_and_lexicon_definition(spark):
    w = World(spark, lex(spark, ("P", []), ("Q", [], "approved", "text")), {"1": ([("A", "x")], ["P", "Q"])})
    v1 = rows(w.v1.nodes, "key", "definition", "def_status", "def_source", "n_papers")
    assert v1 == [("a", "x", "ok", "1", 1), ("p", "", "placeholder", "", 0), ("q", "text", "ok", "", 0)]
    assert rows(w.v2.concepts, "rk", "def_status") == [("a", "ok"), ("p", "placeholder"), ("q", "placeholder")]


@pytest.mark.parametrize("ptype, status", [("other", "placeholder"), ("survey", "n/a"), ("technique", "ok")])
def test_v1_def_status_by_type(spark, ptype, status):
    w = World(spark, lex(spark, ("Z", [])), {"1": ([("A", "x")], [], {"paper_type": ptype})})
    assert rows(w.v1.nodes, "def_status") == [(status,)]


def test_rejected_home(spark):
    w = World(spark, lex(spark, ("R", [], "rejected"), ("A", []), ("B", [])),
              {"1": ([("R", "r"), ("A", "a")], ["B"])})
    assert rows(w.v1.edges) == []
    assert rows(view.builds_on(w.v2)) == [("a", "b")]


def test_self_loops_and_duplicates(spark):
    w = World(spark, lex(spark, ("A", []), ("B", [])), {"1": ([("A", "")], ["A", "B", "B"])})
    assert rows(w.v1.edges) == [("a", "a"), ("a", "b")]
    assert rows(view.builds_on(w.v2)) == [("a", "b")]
    assert rows(w.v2.edges, "type", "rk") == [
        ("builds_on", "a"), ("builds_on", "b"), ("builds_on", "b"), ("defines", "a")]


def test_paper_without_defines(spark):
    w = World(spark, lex(spark, ("A", [])), {"1": ([], ["A"], {"title": "t" * 60, "paper_type": "survey"})})
    assert rows(w.v1.edges) == [("paper:1", "a")]
    assert rows(w.v1.nodes.filter("key like 'paper:%'"), "canonical", "definition", "status", "def_status") == [
        ("t" * 40, "problem 1", "approved", "n/a")]
    assert rows(w.v1.node_papers) == [("paper:1", "1")]
    assert rows(view.builds_on(w.v2)) == []
    assert rows(view.paper_anchors(w.v2)) == [("paper:1", "a")]
    assert rows(view.paper_defines(w.v2)) == []


def test_blocked(spark):
    w = World(spark, lex(spark, ("P", ["pp"], "pending")), {"1": ([("A", "")], ["P", "New"]), "2": ([], ["pp", "P"])})
    assert rows(graph_v1.blocked_counts(w.v1.blocked)) == [(0, "P", 2), (1, "New", 1), (2, "pp", 1)]
    assert rows(w.v1.edges) == []


def test_lineage_without_content_record(spark):
    w = World(spark, lex(spark, ("A", [])), {"1": ([], ["A", "New"], {"no_content": True}), "2": ([("A", "")], [])})
    assert rows(w.v1.edges) == []
    assert rows(w.v1.registered, "rk") == [("new",)]
    assert rows(w.v2.registered) == []
    assert rows(w.v2.edges, "type") == [("defines",)]


def test_missing_fields_default(spark):
    none = {"title": None, "problem": None, "domain": None, "paper_type": None}
    w = World(spark, lex(spark, ("Z", [])), {"1": ([("A", "d")], [], none), "2": ([], [], none)})
    assert rows(w.v1.nodes, "key", "canonical", "domain", "ptype") == [
        ("a", "A", "general", "technique"), ("paper:2", "2", "general", "technique")]
    assert rows(w.v2.papers, "pid", "title", "domain", "paper_type") == [
        ("1", "1", "general", "other"), ("2", "2", "general", "other")]


def test_view_counts_every_paper_and_takes_the_first_definer(spark):
    w = World(spark, lex(spark, ("A", [])), {
        "2401.1": ([("B", "")], ["A"]),
        "2502.1": ([("A", "")], [], {"paper_type": "", "domain": ""}),
        "2503.1": ([("A", "x"), ("A", "y")], [], {"paper_type": "survey", "domain": "medical"}),
    })
    assert rows(view.concepts(w.v2), "id", "n_papers", "month", "ptype", "domain") == [
        ("a", 3, "2024-01", "technique", "general"), ("b", 1, "2024-01", "technique", "general")]
    assert rows(view.concept_papers(w.v2).filter("rk = 'a'"), "pid") == [("2401.1",), ("2502.1",), ("2503.1",)]
    assert rows(w.v1.nodes, "key", "n_papers") == [("a", 2), ("b", 1)]
    both = view.nodes_with_papers(w.v2)
    assert rows(both.groupBy("type").count()) == [("concept", 2), ("paper", 3)]
    assert rows(view.filter_nodes(both), "id") == [("a",), ("b",)]


def test_filters(spark):
    nodes = spark.createDataFrame(
        [("a", "A", "technique", "general", "2024-01"), ("b", "B", "survey", "medical", None),
         ("c", "B.c", "technique", "medical", "2025-02")],
        "id string, canonical string, ptype string, domain string, month string")
    assert rows(view.filter_nodes(nodes, date_after="2024-02"), "id") == [("c",)]
    assert rows(view.filter_nodes(nodes, ptype="", domain="medical"), "id") == [("b",), ("c",)]
    assert rows(view.filter_nodes(nodes, "technique", "general"), "id") == [("a",)]
    assert rows(view.search(nodes, " b. "), "id") == [("c",)]
    assert rows(view.search(nodes, "  ")) == []
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "x")], "src string, dst string")
    assert rows(view.drop_dangling(edges, nodes)) == [("a", "b"), ("b", "c")]
    assert rows(view.induced_edges(edges, nodes.filter("id <> 'a'"))) == [("b", "c")]
    assert rows(view.links(edges, nodes), "source", "from_type") == [("a", "technique"), ("b", "survey")]
    assert [view.next_match(3, i, True) for i in (0, 2)] == [1, 0] and view.next_match(3, 2, False) == 0


def test_rebuild_twice_changes_nothing(spark, tmp_path):
    w = World(spark, lex(spark, ("A", ["aa"]), ("P", [], "pending")),
              {"1": ([("N", "n")], ["AA", "P", "M"]), "2": ([("A", "")], ["N"])})
    store = Snapshots(spark, str(tmp_path))
    first = rebuild(w.papers, w.mentions, w.lexicon, store)
    again = rebuild(w.papers, w.mentions, store.read("lexicon"), store)
    assert rows(first.lexicon, "ord", "name", "status") == [
        (0, "A", "approved"), (1, "P", "pending"), (2, "N", "unreviewed"), (3, "M", "pending")]
    assert rows(again.lexicon) == rows(first.lexicon)
    for part in ("nodes", "edges", "node_papers"):
        assert rows(getattr(again.v1, part)) == rows(getattr(first.v1, part))
    assert rows(again.v2.concepts) == rows(first.v2.concepts)
    assert store.current("lexicon")[0] == 2
    # on admitted, defined papers the two derivations of lineage agree
    assert rows(first.v1.edges) == rows(view.builds_on(first.v2))
    assert first.counts().first().asDict() == {"nodes": 2, "builds_on": 2}


def test_edges_always_run_from_papers_to_concepts(spark):
    w = World(spark, lex(spark, ("A", [])), {"1": ([("B", "")], ["A", "B"])})
    assert {r["rk"] for r in w.v2.edges.collect()} <= {r["rk"] for r in w.v2.concepts.collect()}
    assert rows(graph_v2.counts(w.v2)) == [
        ("builds_on", 2), ("concepts", 2), ("defines", 1), ("papers", 1), ("placeholders", 1)]
    assert rows(M.registration_counts(w.v2.registered)) == [("unreviewed", 1)]
    assert rows(L.status_counts(w.lexicon)) == [("approved", 1)]
