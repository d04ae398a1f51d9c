import json

import pytest
from conftest import rows
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from test_lexicon import lex

from loomgraph.external import extract_contents, extract_lineage, staged_records
from loomgraph.operators import lexicon as L, mentions as M
from loomgraph.sources import documents as D, papers as PP, records as RR
from loomgraph.sources.snapshots import Snapshots, append_new


def put(folder, name, value):
    (folder / name).write_text(json.dumps(value, ensure_ascii=False, indent=2))


def test_record_files(spark, tmp_path):
    put(tmp_path, "2401.1.concepts.json", {"title": "T", "task": [], "defines": [{"name": "A", "definition": "d"}],
                                           "uses": ["u"], "problem": "p", "domain": "general", "paper_type": "technique"})
    put(tmp_path, "2401.2.concepts.json", {"title": "S", "task": [], "defines": [], "uses": [], "problem": "",
                                           "domain": "general", "paper_type": "survey"})
    put(tmp_path, "2401.1.relations.json", {"builds_on": ["B", "A"]})
    put(tmp_path, "2401.2.relations.json", {"builds_on": []})
    put(tmp_path, "2401.1.parsed.json", {"paper_id": "2401.1", "ok": True, "cut_method": "section", "char_count": 3, "text": "abc"})
    put(tmp_path, "2401.3.parsed.json", {"paper_id": "2401.3", "ok": False, "reason": "gone", "text": ""})
    contents, lineage = RR.read_contents(spark, str(tmp_path)), RR.read_lineage(spark, str(tmp_path))
    assert rows(M.from_records(contents, lineage), "pid", "phase", "pos", "name", "definition") == [
        ("2401.1", 0, 0, "A", "d"), ("2401.1", 1, 0, "B", ""), ("2401.1", 1, 1, "A", "")]
    assert rows(M.papers_of(contents), "pid", "n_defines") == [("2401.1", 1), ("2401.2", 0)]
    parsed = RR.read_parsed(spark, str(tmp_path))
    assert rows(parsed, "pid", "ok", "reason") == [("2401.1", True, None), ("2401.3", False, "gone")]
    assert rows(RR.texts_of(contents, parsed)) == [("2401.1", "abc")]
    assert rows(staged_records(parsed, contents), "pid") == [("2401.1",)]
    assert rows(RR.paper_registry(spark, {"m": ["1", "2"], "n": ["1"]})) == [("1", "m"), ("1", "n"), ("2", "m")]


def test_lexicon_round_trip(spark, tmp_path):
    lx = lex(spark, ('B "x"', ["b1", "b\\2"], "approved", "d\n"), ("A", [], "pending"), ("é", [], "rejected"))
    D.write_document(spark, str(tmp_path / "out"), D.lexicon_section(lx))
    parts = sorted((tmp_path / "out").glob("part-*"))
    text = "".join(p.read_text() for p in parts)
    doc = json.loads(text)
    assert list(doc["techniques"]) == ['B "x"', "A", "é"]
    assert doc["techniques"]['B "x"'] == {"aliases": ["b1", "b\\2"], "status": "approved", "definition": "d\n",
                                          "source": "", "first_seen": ""}
    (tmp_path / "lexicon.json").write_text(text)
    back = RR.read_lexicon_json(spark, str(tmp_path / "lexicon.json"))
    assert rows(back) == rows(lx.select(*back.columns))
    put(tmp_path, "old.json", {"techniques": {"Z": ["z1"], "A": []}, "_comment": "x"})
    old = RR.read_legacy_lexicon_json(spark, str(tmp_path / "old.json"))
    assert rows(L.rows(old), "ord", "name", "aliases", "status") == [(0, "Z", ["z1"], "unreviewed"), (1, "A", [], "unreviewed")]


def test_draw_document(spark, tmp_path):
    nodes = spark.createDataFrame([("b", "B", "ok", "technique", True, "d", 1, "general")],
                                  "id string, label string, def_status string, ptype string, has_def boolean, "
                                  "definition string, n_papers bigint, domain string")
    links = spark.createDataFrame([("b", "a", "builds_on", "technique"), ("a", "b", "builds_on", "survey")],
                                  "source string, target string, kind string, from_type string")
    sims = spark.createDataFrame([], "source string, target string, sim double")
    papers = spark.createDataFrame([("b", "2"), ("b", "1"), ("b", "10")], "rk string, pid string")
    D.write_document(spark, str(tmp_path / "o"), D.draw_sections(nodes, links, sims, papers), "<p>__DATA__</p>")
    text = "".join(p.read_text() for p in sorted((tmp_path / "o").glob("part-*")))
    assert text.startswith("<p>{") and text.rstrip().endswith("}</p>")
    doc = json.loads(text.strip()[3:-4])
    assert [n["id"] for n in doc["nodes"]] == ["b"] and doc["sim_pairs"] == []
    assert doc["nodes"][0]["papers"] == ["1", "10", "2"]
    assert [(x["source"], x["target"]) for x in doc["links"]] == [("a", "b"), ("b", "a")]


def written(folder):
    return json.loads("".join(p.read_text() for p in sorted(folder.glob("part-*"))))


def test_other_documents(spark, tmp_path):
    labels = spark.createDataFrame([("a", 'A "q"'), ("b", "B")], "key string, label string")
    sims = spark.createDataFrame([("define", "a", "b", 0.5), ("task", "a", "b", 0.25)],
                                 "field string, a string, b string, sim double")
    D.write_document(spark, str(tmp_path / "s"), D.similarity_sections(labels, sims))
    assert written(tmp_path / "s") == {
        "labels": {"a": 'A "q"', "b": "B"},
        "sims": {"define": [{"a": "a", "b": "b", "sim": 0.5}], "problem": [], "task": [{"a": "a", "b": "b", "sim": 0.25}]}}
    store = spark.createDataFrame([("m", "concept:a", [0.5, 1.0]), ("old", "x", [1.0])], "model string, id string, vec array<double>")
    D.write_document(spark, str(tmp_path / "v"), D.vector_sections(store, "m", 2))
    assert written(tmp_path / "v") == {"model": "m", "dim": 2, "vectors": {"concept:a": [0.5, 1.0]}}
    from loomgraph.schemas import LEDGER
    ledger = spark.createDataFrame([("1", "t", "a", "p", ["c"], None, False, "q")], LEDGER)
    D.write_document(spark, str(tmp_path / "l"), D.ledger_section(ledger))
    assert written(tmp_path / "l") == {"1": {"title": "t", "abstract": "a", "published": "p", "categories": ["c"],
                                             "gate": None, "extracted": False, "first_seen_query": "q"}}
    from test_graphs import World
    w = World(spark, lex(spark, ("A", [])), {"1": ([("A", "")], ["A", "A"]), "2": ([], ["A"])})
    D.write_document(spark, str(tmp_path / "g"), D.graph_v2_sections(w.v2.papers, w.v2.concepts, w.v2.edges))
    doc = written(tmp_path / "g")
    assert sorted(doc["nodes"]) == ["concept:a", "paper:1", "paper:2"]
    assert doc["nodes"]["concept:a"] == {"type": "concept", "canonical": "A", "definition": "", "def_status": "ok", "status": "approved"}
    assert doc["edges"] == [{"type": t, "from": f"paper:{p}", "to": "concept:a"} for t, p in
                            (("defines", 1), ("builds_on", 1), ("builds_on", 1), ("builds_on", 2))]
    D.write_document(spark, str(tmp_path / "g1"), D.graph_v1_sections(w.v1.nodes, w.v1.edges, w.v1.node_papers))
    one = written(tmp_path / "g1")
    assert [one["nodes"][k]["papers"] for k in ("a", "paper:2")] == [["1"], ["2"]]
    assert sorted(one["nodes"]) == ["a", "paper:2"] and one["builds_on"] == [
        {"from": "a", "to": "a"}, {"from": "paper:2", "to": "a"}]
    assert rows(RR.dry_run(w.papers, 1), "pid") == [("1",)]


def test_snapshots(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path))
    assert not s.exists("t") and s.read("t", "a int").count() == 0
    with pytest.raises(FileNotFoundError):
        s.read("t")
    s.write("t", spark.range(3))
    s.write("t", s.read("t").withColumn("id", F.col("id") + 1))  # from itself
    s.write("other", spark.range(1))
    assert rows(s.read("t")) == [(1,), (2,), (3,)] and s.current("t")[0] == 2


def test_append_new(spark, tmp_path):
    path = str(tmp_path / "x")
    one = spark.createDataFrame([("1", "a", "m")], "pid string, v string, map_name string")
    more = spark.createDataFrame([("1", "changed", "m"), ("2", "b", "m")], one.schema)
    append_new(one, path, "pid", partition_by=["map_name"])
    append_new(more, path, "pid", partition_by=["map_name"])
    assert rows(spark.read.parquet(path), "pid", "v") == [("1", "a"), ("2", "b")]
    with pytest.raises(AnalysisException):  # a wrong key is no first write
        append_new(more.withColumn("other", F.lit(1)), path, "other")
    append_new(more, path, "pid", force=True, partition_by=["map_name"])
    assert spark.read.parquet(path).count() == 4


class Pages:
    def pages(self, content):
        yield from content.decode().split("\f")


class Web:
    def fetch(self, pid):
        if pid == "bad":
            raise OSError("timeout")
        return (b"tiny" if pid == "small" else b"x" * 10000)


class Reader:
    def content(self, text):
        return {"title": text[:3], "task": [], "defines": [{"name": text[:1], "definition": ""}], "uses": [],
                "problem": "", "domain": "general", "paper_type": "technique"}

    def lineage(self, content, text):
        return {"builds_on": [content["defines"][0]["name"] + "0"]}


def test_pdf_files(spark, tmp_path):
    (tmp_path / "p.pdf").write_bytes(b"one\ftwo".ljust(10000, b" "))
    (tmp_path / "q.pdf").write_bytes(b"small")
    stored = PP.read_pdfs(spark, str(tmp_path))
    assert rows(stored, "paper_id") == [("p",)]
    got = PP.decode_pages(stored, Pages())
    assert [(r["page"], r["text"].strip()) for r in got.orderBy("page").collect()] == [(0, "one"), (1, "two")]
    assert got.filter("error is not null").count() == 0

    class Broken:
        def pages(self, content):
            raise ValueError("no pdf")

    assert rows(PP.decode_pages(stored, Broken())) == [("p", None, None, "no pdf")]
    want = spark.createDataFrame([("p",), ("new",), ("bad",), ("small",)], "pid string")
    assert rows(PP.download_missing(want, stored, Web(), pause=0), "paper_id", "ok", "message") == [
        ("bad", False, "timeout"), ("new", True, "downloaded"), ("small", False, "too small")]


def test_extraction_service(spark):
    parsed = spark.createDataFrame([("1", "abc"), ("2", "xyz")], "pid string, text string")
    contents = extract_contents(parsed, Reader())
    assert rows(contents, "pid", "title", "paper_type") == [("1", "abc", "technique"), ("2", "xyz", "technique")]
    assert rows(extract_lineage(contents, parsed, Reader())) == [("1", ["a0"], None), ("2", ["x0"], None)]

    class Moody(Reader):
        def content(self, text):
            if text == "xyz":
                raise RuntimeError("busy")
            return super().content(text)

        def lineage(self, content, text):
            assert content["names"] == "a"
            raise RuntimeError("later")

    contents = extract_contents(parsed, Moody())
    assert rows(contents, "pid", "title", "error") == [("1", "abc", None), ("2", None, "busy")]
    assert rows(extract_lineage(contents.filter("error is null"), parsed, Moody())) == [("1", [], "later")]


def test_import_of_record_files(spark, tmp_path):
    from loomgraph.plans.extraction import import_records
    store = Snapshots(spark, str(tmp_path / "store"))
    folder = tmp_path / "records"
    folder.mkdir()
    for pid, title in (("1", "one"), ("2", "two")):
        put(folder, f"{pid}.concepts.json", {"title": title, "task": [], "defines": [{"name": f"N{pid}", "definition": ""}],
                                             "uses": [], "problem": "", "domain": "general", "paper_type": "technique"})
        put(folder, f"{pid}.relations.json", {"builds_on": ["N1"]})
    import_records(store, str(folder))
    assert rows(store.read("papers"), "pid", "title") == [("1", "one"), ("2", "two")]
    put(folder, "1.relations.json", {"builds_on": []})
    import_records(store, str(folder))
    assert store.read("mentions").count() == 4
    import_records(store, str(folder), force=True)
    assert rows(store.read("mentions"), "pid", "phase", "name") == [("1", 0, "N1"), ("2", 0, "N2"), ("2", 1, "N1")]


ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom">
<entry><id>http://arxiv.org/abs/{0}v1</id><title>T {0}</title><summary>s
 t</summary><published>2024-05-0{1}T00:00:00Z</published><category term="cs.CL"/><category term="cs.IR"/></entry>
<entry><id>http://arxiv.org/abs/2401.9v2</id><title>last</title><summary>x</summary>
<published>2024-01-01T00:00:00Z</published><category term="cs.CL"/></entry></feed>"""


def test_atom_feed(spark, tmp_path):
    from loomgraph.operators.collect import search_results
    (tmp_path / "0.atom").write_text(ATOM.format("2405.1", 2))
    (tmp_path / "1.atom").write_text(ATOM.format("2405.2", 3))
    queries = spark.createDataFrame([("0.atom", 0, "q0"), ("1.atom", 1, "q1")], "file_name string, query_ord int, query string")
    feed = PP.read_atom(spark, str(tmp_path), queries)
    assert rows(feed, "query_ord", "entry_ord", "id") == [
        (0, 0, "http://arxiv.org/abs/2405.1v1"), (0, 1, "http://arxiv.org/abs/2401.9v2"),
        (1, 0, "http://arxiv.org/abs/2405.2v1"), (1, 1, "http://arxiv.org/abs/2401.9v2")]
    assert rows(search_results(feed), "aid", "first_seen_query", "abstract", "categories") == [
        ("2401.9", "q0", "x", ["cs.CL"]), ("2405.1", "q0", "s t", ["cs.CL", "cs.IR"]),
        ("2405.2", "q1", "s t", ["cs.CL", "cs.IR"])]
    feed.write.json(str(tmp_path / "staged"))
    assert PP.read_feed(spark, str(tmp_path / "staged")).count() == 4


def test_equal_rows_and_line_separators_are_read_back(spark, tmp_path):
    """Of equal first rows one alone goes without a comma; a row may hold U+2028, which no `.` matches."""
    edges = spark.createDataFrame([("a\u2028b", "c"), ("a\u2028b", "c"), ("d", "e")], "src string, dst string")
    path = str(tmp_path / "doc")
    D.write_document(spark, path, [D.Section("edges", edges, F.struct(F.col("src").alias("from"), F.col("dst").alias("to")), F.col("src"))])
    assert rows(D.read_edges(spark, path), "from", "to") == [("a\u2028b", "c"), ("a\u2028b", "c"), ("d", "e")]
    text = "\n".join(r[0] for r in spark.read.text(path).withColumn("f", F.input_file_name()).withColumn("n", F.monotonically_increasing_id()).orderBy("f", "n").collect())
    assert len(json.loads(text)["edges"]) == 3
