import random
import re

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import nodes as N, text as X


@pytest.mark.parametrize("raw, key", [
    (" Hippo-RAG  2", "hippo rag 2"),
    ("hippo rag 2", "hippo rag 2"),
    ("GraphRAG", "graphrag"),
    ("Graph-RAG", "graph rag"),
    ("a\u00a0b\tc\n", "a b c"),
    ("-", ""),
])
def test_canon(one, raw, key):
    assert one(X.canon, raw) == key


@pytest.mark.parametrize("raw, want", [
    ("concept:graph rag", "graph rag"), ("paper:a:b", "a:b"), ("plain", "plain"), ("", ""),
])
def test_strip_prefix(one, raw, want):
    assert one(X.strip_prefix, raw) == want


@pytest.mark.parametrize("raw, want", [
    ("2502.14192", "2025-02"), ("hep-th/9901001", None), ("9913.1", "2099-13"), ("", None),
])
def test_arxiv_month(one, raw, want):
    assert one(X.arxiv_month, raw) == want


def test_earliest_month(one):
    assert one(X.earliest_month, ["2502.14192", "2401.00001", "x"], "array<string>") == "2024-01"
    assert one(X.earliest_month, [], "array<string>") is None
    assert one(X.earliest_month, ["x"], "array<string>") is None


@pytest.mark.parametrize("raw, want", [
    ("http://papers.example.org/abs/2307.00042v3", "2307.00042"),
    ("1911.90210v1", "1911.90210"),
    ("http://papers.example.org/abs/math/0404188v2/", "0404188"),
    (None, ""),
    ("v12", ""),
    ("av2b", "av2b"),
])
def test_normalize_paper_id(one, raw, want):
    assert one(X.normalize_paper_id, raw) == want


def test_squeeze_dates_and_lists(one):
    assert one(X.squeeze, "  a \n\t b ") == "a b"
    assert one(X.squeeze, None) == ""
    assert one(X.iso_day, "2024-05-06T07:08:09Z") == "2024-05-06"
    assert one(X.year_month, None) == ""
    assert one(X.join_tasks, ["a", "b"], "array<string>") == "a b"
    assert one(X.join_tasks, None, "array<string>") == ""
    assert one(X.tag_terms, [("cs.CL",), ("cs.IR",)], "array<struct<term:string>>") == ["cs.CL", "cs.IR"]
    defines = "array<struct<name:string,definition:string>>"
    assert one(X.defined_names, [("A", ""), ("B", "x")], defines) == "A, B"
    assert one(X.defined_names, [], defines) == "(none)"


def test_contains_is_literal(one):
    assert one(lambda c: X.contains_text(c, " A.B "), "xa.bx")
    assert not one(lambda c: X.contains_text(c, "a.b"), "xaxbx")
    assert one(lambda c: X.contains_any(c, ["Ring", "bolt"]), "BOLTED")


def is_word_char(c):
    return c.isalnum() or c == "_"


def expected_cut(text):
    """Walks over the lines that begin late enough and tests each head where the line's ink begins."""
    low, start = text.lower(), 0
    for at in range(len(low)):
        if low.startswith("abstract", at) and not (at and is_word_char(low[at - 1])) and not is_word_char(low[at + 8: at + 9] or " "):
            start = at
            break
    line = 0
    while True:
        if line >= start + 50:
            ink = len(text) - len(text[line:].lstrip())
            if any(re.match(head, text[ink:], re.IGNORECASE) for head in X.NEXT_SECTION_HEADS):
                return text[start:line], "section"
        line = text.find("\n", line) + 1
        if not line:
            return text[:6000], "head6000"


def test_find_cut_cases(one):
    pad = "x" * 60
    cases = [
        (f"Title\nAbstract\n{pad}\n2 Related\nrest", f"Abstract\n{pad}\n", "section"),
        (f"Abstract {pad} related work\nmore", f"Abstract {pad} related work\nmore", "head6000"),
        ("Abstract " + "y" * 40 + "background and more", "Abstract " + "y" * 40 + "background and more", "head6000"),
        ("no section " * 900, ("no section " * 900)[:6000], "head6000"),
        (f"Abstract {pad}\n \n\t## 2 Method", f"Abstract {pad}\n", "section"),
        (f"abstractly {pad}\nPreliminaries", f"abstractly {pad}\n", "section"),
        ("", "", "head6000"),
    ]
    for text, want, method in cases:
        got = one(X.find_cut, text)
        assert (got["text"], got["cut_method"]) == (want, method), text[:80]
    assert one(lambda c: X.find_cut(c, None), "no section " * 900)["text"] == "no section " * 900
    assert one(lambda c: X.find_cut(c, 7), "no section") == ("no sect", "head7")


def test_find_cut_random(spark):
    rnd = random.Random(7)
    bits = ["abstract", "Abstract", "abstracts", "\n", "\r", "\r\n", "\u2028", "\x85", "\u00a0", " ", "  ",
            "2 M", "2. r", "2.5", "## 2", "# 2b", "#2", "related work", "Background", "PRELIMINARIES", "2 related",
            "😀", "é", "word", "x" * 23, "y" * 50, "\x1c", "\t"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 40))) for _ in range(4000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: (r["c"]["text"], r["c"]["cut_method"]) for r in df.select("i", X.find_cut("t").alias("c")).collect()}
    wrong = [i for i, t in enumerate(texts) if got[i] != expected_cut(t)]
    assert not wrong, (len(wrong), texts[wrong[0]], got[wrong[0]], expected_cut(texts[wrong[0]]))
    assert sum(m == "section" for _, m in got.values()) > 500


def test_node_expressions(spark):
    df = spark.createDataFrame(
        [("A", "d", "technique", "ok"), ("A", " ", "survey", "placeholder"), ("A", "d", "other", "ok"),
         ("A", "d", "survey", "placeholder")],
        "name string, definition string, ptype string, def_status string")
    c = F.col
    got = df.select(
        N.v1_def_status(c("definition"), c("ptype")).alias("s"),
        N.node_text(c("name"), c("definition"), c("ptype")).alias("t"),
        N.concept_line(c("name"), c("definition"), c("def_status"), F.lit(0.345)).alias("l"),
        N.paper_line(c("name"), c("definition"), F.lit(0.5)).alias("p"),
        N.typed_embed_text(F.lit("concept"), c("definition"), F.lit("")).alias("e"),
    ).collect()
    assert [r["s"] for r in got] == ["ok", "n/a", "placeholder", "n/a"]
    assert [r["t"] for r in got] == ["A: d", "A (survey)", "A: d", "A: d"]
    assert got[0]["l"].startswith("- A: d [0.3") and got[3]["l"].startswith("- A (no definition yet)")
    assert got[1]["p"] == "- A — (no problem statement) [0.50]"
    assert [r["e"] for r in got] == ["d", None, "d", "d"]
