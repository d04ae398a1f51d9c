import pytest
from conftest import rows
from test_sources import Pages, Reader

from loomgraph.api import Workbench
from loomgraph.external import HashingEmbedder, KeywordClassifier, TemplateAssistant
from loomgraph.plans import commands as K
from loomgraph.plans.decisions import next_step
from loomgraph.plans.extraction import Extraction
from loomgraph.plans.workflow import CollectWorkflow, Graph, WorkflowError
from loomgraph.schemas import CONTENT, FEED, LEXICON, MENTIONS, PAPERS
from loomgraph.sources.snapshots import Snapshots
from loomgraph.streaming.ingest import ledger_stream, lexicon_stream


@pytest.mark.parametrize("stage, decision, want, strict", [
    ("interpret", "revise:x", "parse", "parse"),
    ("interpret", "proceed", "expand_search", "expand_search"),
    ("interpret", "cancel", "report", "expand_search"),
    ("approve", "proceed", "gate", "gate"),
    ("approve", "cancel", "report", "report"),
    ("extract_confirm", "proceed", "extract", "extract"),
    ("extract_confirm", "revise:x", "report", "report"),
])
def test_routes(stage, decision, want, strict):
    assert next_step(stage, decision) == want
    assert next_step(stage, decision, True) == strict


ENTRIES = [(0, "q", 0, "2401.1v1", "Graph retrieval", "a method", "2024-01-03", []),
           (0, "q", 1, "2401.2v1", "A survey", "of methods", "2024-01-02", []),
           (0, "q", 2, "2401.3", "More retrieval", "a method", "2024-01-01", []),
           (0, "q", 3, "2401.4", "Third", "a method", "2023-12-01", []),
           (0, "q", 4, "9", "Owned", "a method", "2023-11-01", [])]


class Web:
    def fetch(self, pid):
        if pid == "2401.3":
            raise OSError("timeout")
        return ("Abstract\f" + "x" * 11000).encode()


def workflow(spark, root, calls, **more):
    store = Snapshots(spark, str(root))
    e = HashingEmbedder(32)
    concepts = spark.createDataFrame(
        [("concept:graph retrieval", "Graph Retrieval", "graph retrieval", "ok")],
        "id string, canonical string, definition string, def_status string")
    papers = spark.createDataFrame([("paper:9", "Owned", "graph retrieval of text")], "id string, title string, problem string")
    vectors = spark.createDataFrame(
        [("concept:graph retrieval", e.embed(["graph retrieval"])[0]), ("paper:9", e.embed(["graph retrieval of text"])[0])],
        "id string, vec array<double>")

    def search(queries):
        calls.append("search")
        return spark.createDataFrame(ENTRIES, FEED)

    extraction = Extraction(store, Web(), Pages(), Reader(), pause=0)

    def extract(wanted, run):
        calls.append("extract")
        return extraction.run(wanted, run)

    return CollectWorkflow(store, lambda: Graph(concepts, papers, vectors), TemplateAssistant(), e, search,
                           KeywordClassifier(), extract, today=lambda: "2024-06-01", **more)


def test_whole_run(spark, tmp_path):
    calls = []
    w = workflow(spark, tmp_path, calls)
    first = w.start(" graph retrieval ")
    assert (first["stage"], first["topic"], first["done"]) == ("interpret", "graph retrieval", False)
    assert "Graph Retrieval: graph retrieval" in first["report"] and "Owned" in first["report"]
    thread = first["thread_id"]
    assert w.resume(thread, "revise: graph retrieval of things")["topic"] == "graph retrieval of things"
    assert calls == []
    # another process picks the thread up
    w = workflow(spark, tmp_path, calls)
    approve = w.resume(thread, "proceed")
    assert approve["stage"] == "approve"
    assert approve["counts"] == {"found": 5, "owned_excluded": 1, "gate_excluded": 0, "new": 4}
    confirm = w.resume(thread, "proceed")
    assert confirm["stage"] == "extract_confirm" and confirm["passed_count"] == 3
    assert confirm["to_extract"] == ["2401.1", "2401.3"]
    assert rows(confirm["gate_summary"]) == [("2401.1", "technique", True), ("2401.2", "survey", False),
                                             ("2401.3", "technique", True), ("2401.4", "technique", True)]
    assert calls == ["search"]
    done = w.resume(thread, "proceed")
    assert done["done"] and done["extracted"] == ["2401.1"] and calls == ["search", "extract"]
    assert rows(w.table(thread, "extracted"), "aid", "ok", "message") == [
        ("2401.1", True, "extracted: downloaded"), ("2401.3", False, "download failed: timeout")]
    ledger = w.store.read("ledger")
    assert rows(ledger, "aid", "extracted", "gate.verdict", "gate.date") == [
        ("2401.1", True, "technique", "2024-06-01"), ("2401.2", False, "survey", "2024-06-01"),
        ("2401.3", False, "technique", "2024-06-01"), ("2401.4", False, "technique", "2024-06-01"),
        ("9", False, None, None)]
    assert w.resume(thread, "proceed") == done
    assert rows(w.table(thread, "left_over"), "aid") == [("2401.4",)]
    # what was extracted is in the graph after a rebuild, and is not extracted again
    assert Workbench(spark, str(tmp_path)).rebuild() == {"ok": True, "nodes": 1, "builds_on": 0}
    assert rows(w.store.read("v2_concepts"), "canonical") == [("A",)]
    again = Extraction(w.store, None, None, None).run(spark.createDataFrame([("2401.1",)], "aid string"), "again")
    assert rows(again) == [("2401.1", True, "already stored")]


def test_uncapped_run(spark, tmp_path):
    w = workflow(spark, tmp_path, [], max_extract=None)
    t = w.start("graph retrieval")["thread_id"]
    w.resume(t, "proceed")
    confirm = w.resume(t, "proceed")
    assert [r["aid"] for r in confirm["to_extract"].collect()] == ["2401.1", "2401.3", "2401.4"]
    assert w.resume(t, "proceed")["extracted"] == 2 and w.table(t, "left_over").count() == 0


def test_search_has_one_path(spark):
    from loomgraph.operators import collect as C
    feed = spark.createDataFrame([(0, "q", i, f"24{i % 12 + 1:02d}.{i}", "t", "s", f"2024-01-{i % 28 + 1:02d}", []) for i in range(60)], FEED)
    assert C.search_results(feed).count() == 60 and C.search_results(feed, limit=50).count() == 50


def test_cancel_at_each_stage(spark, tmp_path):
    calls = []
    w = workflow(spark, tmp_path, calls)
    t = w.start("graph retrieval")["thread_id"]
    assert w.resume(t, "cancel")["summary"].startswith("collection cancelled")
    assert calls == []
    t = w.start("graph retrieval")["thread_id"]
    w.resume(t, "proceed")
    out = w.resume(t, "cancel")
    assert out["done"] and out["extracted"] == [] and out["summary"].startswith("collection cancelled")
    t = w.start("graph retrieval")["thread_id"]
    w.resume(t, "proceed")
    w.resume(t, "proceed")
    out = w.resume(t, "cancel")
    assert out["summary"].startswith("extraction cancelled: 4 judged, 3 passed") and out["extracted"] == []
    assert "extract" not in calls
    assert w.store.read("ledger").filter("extracted").count() == 0


def test_bad_requests(spark, tmp_path):
    w = workflow(spark, tmp_path, [])
    for call, kind in ((lambda: w.start("  "), "bad_request"), (lambda: w.resume("", "proceed"), "bad_request"),
                       (lambda: w.resume("x", ""), "bad_request"), (lambda: w.resume("unknown", "proceed"), "not_found")):
        with pytest.raises(WorkflowError) as e:
            call()
        assert e.value.kind == kind


def test_workbench(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    store.write("papers", spark.createDataFrame([("2401.1", "T", "p", [], "general", "technique"),
                                                 ("2402.1", "S", "", [], "general", "survey")], PAPERS))
    store.write("mentions", spark.createDataFrame(
        [("2401.1", 0, 0, "New-Thing", "d"), ("2401.1", 1, 0, "base", ""), ("2402.1", 1, 0, "Base", "")], MENTIONS))
    store.write("lexicon", spark.createDataFrame([(0, "Base", [], "pending", "", "", ""), (1, "BASE model", [], "approved", "", "", "")], LEXICON))

    class Fixed:
        def translate(self, text, names):
            self.names = [r[0] for r in names.collect()]
            return {"tool": "focus_lineage", "args": {"node": "New-Thing"}}

    b = Workbench(spark, str(tmp_path), translator=Fixed())
    assert b.rebuild() == {"ok": True, "nodes": 1, "builds_on": 0}
    assert b.merge_lexicon("Base", "BASE model")["aliases"] == ["Base"]
    assert b.rebuild() == {"ok": True, "nodes": 2, "builds_on": 1}
    assert rows(b.graph().builds_on) == [("new thing", "base model")]
    full = b.graph(papers=True)
    assert full.nodes.count() == 4 and rows(full.paper_builds_on) == [("paper:2402.1", "base model")]
    assert rows(full.defines) == [("paper:2401.1", "new thing")]
    call = b.command("show the lineage")
    assert call == {"tool": "focus_lineage", "args": {"node": "New-Thing"}} and b.translator.names == ["BASE model", "New-Thing"]
    shown = b.run(K.to_request(call))
    assert rows(shown.ids) == [("base model",), ("new thing",)]
    assert b.patch_lexicon("New-Thing", {"status": "rejected"})["status"] == "rejected"
    assert b.rebuild()["nodes"] == 1
    plan = spark.createDataFrame([], "name string, action string, into string")
    assert rows(b.classify_pending(plan)) == [("approved", 1), ("rejected", 1)]
    assert rows(b.lexicon(), "name") == [("BASE model",), ("New-Thing",)]
    assert rows(b.refresh_vectors(HashingEmbedder(8)), "type", "n", "dim") == [("paper", 1, 8)]
    contents = spark.createDataFrame([(str(i), "T", [], [(f"N{i}", f"text {i}")], [], "same", "general", "technique") for i in range(3)],
                                     f"pid string, {CONTENT}")
    sims = b.similarity(contents, HashingEmbedder(8), top=2)
    assert rows(sims.summary, "field", "pairs") == [("define", 3), ("problem", 3)]
    assert rows(sims.top.groupBy("field").count()) == [("define", 2), ("problem", 2)] and b.store.read("similarity").count() == 4


def test_streams(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "store"))
    feed = str(tmp_path / "feed")
    ckpt = str(tmp_path / "ckpt")
    spark.createDataFrame(ENTRIES[:3], FEED).coalesce(1).write.mode("append").json(feed)
    ledger_stream(spark, feed, store, ckpt).awaitTermination()
    assert store.read("ledger").count() == 3
    spark.createDataFrame(ENTRIES[2:], FEED).coalesce(1).write.mode("append").json(feed)
    ledger_stream(spark, feed, store, ckpt).awaitTermination()
    assert rows(store.read("ledger"), "aid") == [("2401.1",), ("2401.2",), ("2401.3",), ("2401.4",), ("9",)]
    m = str(tmp_path / "mentions")
    spark.createDataFrame([("1", 0, 0, "A", "d"), ("1", 1, 0, "B", "")], MENTIONS).write.json(m)
    lexicon_stream(spark, m, store, str(tmp_path / "ckpt2")).awaitTermination()
    spark.createDataFrame([("2", 0, 0, "b", "d"), ("2", 0, 1, "C", "")], MENTIONS).write.mode("append").json(m)
    lexicon_stream(spark, m, store, str(tmp_path / "ckpt2")).awaitTermination()
    assert rows(store.read("lexicon"), "ord", "name", "status") == [
        (0, "A", "unreviewed"), (1, "B", "pending"), (2, "C", "unreviewed")]
