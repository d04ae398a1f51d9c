"""Export of tables as one JSON (or HTML) document, written in parallel.

A document is laid out as ordered text lines, one per row plus the brackets around them,
and written with a range-partitioned sort: the part files, read in name order, are the
document. No row set is gathered on the driver or in one task.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomgraph.operators.ordering import with_row_index
from loomgraph.schemas import LEDGER
from loomgraph.session import stored


@dataclass
class Section:
    """A member of the top-level object: an array of rows, or an object when `key` is set.
    A section without a name puts its entries into the top-level object itself."""

    name: str
    rows: DataFrame
    value: Column            # a struct, array or map; or a string when `text` is set
    order: Column            # sort key within the section, unique
    key: Column | None = None
    text: bool = False
    json_text: bool = False  # the value is JSON text already
    before: str = ""         # literal text in front of the section and behind it
    after: str = ""
    list_name: str = ""      # a member of every row's object that is a list of strings,
    items: DataFrame | None = None  # from rows (of, item): one line each, never an array
    item_key: Column | None = None  # what `of` refers to


def _quoted(text: Column) -> Column:
    """A JSON string literal."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("s"))), r'(?s)^\{"s":(.*)\}$', 1)


def lines(spark: SparkSession, sections: list[Section], head: str = "", tail: str = "") -> DataFrame:
    """section, step, at, body, n, slot, item, value: the document's lines, and their order in all but the last."""

    def mark(i: int, step: int, text: str) -> DataFrame:
        return spark.range(1).select(
            F.lit(i).alias("section"), F.lit(step).alias("step"),
            F.lit("").alias("at"), F.lit("").alias("body"), F.lit(0).cast("bigint").alias("n"),
            F.lit(0).alias("slot"), F.lit("").alias("item"), F.lit(text).alias("value"),
        )

    out = mark(-1, 0, head + "{")
    for i, s in enumerate(sections):
        left, right = ("{", "}") if s.key is not None else ("[", "]")
        opening = f'"{s.name}": {left}' if s.name else ""
        out = out.unionByName(mark(i, 0, ("," if i else "") + s.before + opening))
        if s.json_text:
            body = s.value
        elif s.text:
            body = _quoted(s.value)
        else:
            body = F.to_json(s.value, {"ignoreNullFields": "false"})
        if s.key is not None:
            body = F.concat(_quoted(s.key), F.lit(": "), body)
        of = F.lit(None).cast("string") if s.item_key is None else s.item_key
        # written once, so that a section is computed once; `n` keeps equal rows apart, so one of them is the first
        picked = stored(s.rows.select(s.order.cast("string").alias("at"), body.alias("body"), of.alias("of"),
                                      F.monotonically_increasing_id().alias("n")))
        least = picked.agg(F.min(F.struct("at", "body", "n"))["n"]).scalar()
        placed = picked.withColumn("value", F.concat(F.when(F.col("n") == least, "").otherwise(","), "body"))
        if s.items is not None:
            placed = _with_lists(placed, s)
        else:
            placed = placed.withColumns({"slot": F.lit(0), "item": F.lit("")})
        out = out.unionByName(
            placed.select(F.lit(i).alias("section"), F.lit(1).alias("step"), *PLACE[2:], "value")
        ).unionByName(mark(i, 2, (right if s.name else "") + s.after))
    return out.unionByName(mark(len(sections), 0, "}" + tail))


#: The order of a document's lines.
PLACE = ("section", "step", "at", "body", "n", "slot", "item")


def _with_lists(placed: DataFrame, s: Section) -> DataFrame:
    """Opens the list in each row's object, adds its items as lines in order, and closes it."""
    items = s.items.select("of", "item").distinct()
    least = items.groupBy("of").agg(F.min("item").alias("least"))
    inner = items.join(least, "of").join(placed.select("of", "at", "body", "n"), "of").select(
        "at", "body", "n", F.lit(1).alias("slot"), "item",
        F.concat(F.when(F.col("item") == F.col("least"), "").otherwise(","), _quoted(F.col("item"))).alias("value"))
    opened = F.concat(F.regexp_replace("value", r"\}$", ""), F.lit(f', "{s.list_name}": ['))
    return (
        placed.select("at", "body", "n", F.lit(0).alias("slot"), F.lit("").alias("item"), opened.alias("value"))
        .unionByName(inner)
        .unionByName(placed.select("at", "body", "n", F.lit(2).alias("slot"), F.lit("").alias("item"), F.lit("]}").alias("value")))
    )


def write_document(spark: SparkSession, path: str, sections: list[Section],
                   template: str | None = None, marker: str = "__DATA__") -> None:
    """Writes the document under `path`; with a template, around its marker."""
    head, tail = template.split(marker, 1) if template else ("", "")
    lines(spark, sections, head, tail).orderBy(*PLACE).select("value").write.mode(
        "error"
    ).text(path)


def lexicon_section(lexicon: DataFrame) -> list[Section]:
    fields = F.struct("aliases", "status", "definition", "source", "first_seen")
    return [Section("techniques", lexicon, fields, F.lpad(F.col("ord").cast("string"), 20, "0"), F.col("name"))]


def similarity_sections(labels: DataFrame, node_pairs: DataFrame,
                        fields: tuple[str, ...] = ("define", "problem", "task")) -> list[Section]:
    """Labels by node, and under `sims` one list of pairs per field."""
    out = [Section("labels", labels, F.col("label"), F.col("key"), F.col("key"), text=True)]
    for i, f in enumerate(fields):
        out.append(Section(
            f, node_pairs.filter(F.col("field") == f), F.struct("a", "b", "sim"),
            F.concat_ws("\u0000", "a", "b"),
            before='"sims": {' if i == 0 else "", after="}" if i == len(fields) - 1 else "",
        ))
    return out


def vector_sections(store: DataFrame, model: str, dim: int) -> list[Section]:
    rows = store.filter((F.col("model") == model) & F.col("vec").isNotNull())
    head = f'"model": {json.dumps(model)}, "dim": {dim}, '
    return [Section("vectors", rows, F.col("vec"), F.col("id"), F.col("id"), before=head)]


def ledger_section(ledger: DataFrame) -> list[Section]:
    value = F.struct("title", "abstract", "published", "categories", "gate", "extracted", "first_seen_query")
    return [Section("", ledger, value, F.col("aid"), F.col("aid"))]


def graph_v2_sections(papers: DataFrame, concepts: DataFrame, edges: DataFrame) -> list[Section]:
    """Typed nodes by prefixed id, and the edge list in paper order. An edge's place within
    its paper breaks ties, so duplicates stay."""
    paper = papers.select(
        F.concat(F.lit("paper:"), "pid").alias("id"),
        F.to_json(F.struct(F.lit("paper").alias("type"), "title", "problem", "task", "domain", "paper_type"),
                  {"ignoreNullFields": "false"}).alias("body"))
    concept = concepts.select(
        F.concat(F.lit("concept:"), "rk").alias("id"),
        F.to_json(F.struct(F.lit("concept").alias("type"), "canonical", "definition", "def_status", "status"),
                  {"ignoreNullFields": "false"}).alias("body"))
    nodes = paper.unionByName(concept)
    numbered = with_row_index(edges, [F.col("pid"), F.col("phase"), F.col("pos")], "i")
    edge = F.struct("type", F.concat(F.lit("paper:"), "pid").alias("from"),
                    F.concat(F.lit("concept:"), "rk").alias("to"))
    return [
        Section("nodes", nodes, F.col("body"), F.col("id"), F.col("id"), json_text=True),
        Section("edges", numbered, edge, F.lpad(F.col("i").cast("string"), 20, "0")),
    ]


def graph_v1_sections(nodes: DataFrame, edges: DataFrame, node_papers: DataFrame) -> list[Section]:
    """Nodes by key, each with the ordered list of its papers (`node_papers`: key, pid)."""
    value = F.struct("canonical", "definition", "def_source", "domain", "ptype", "status", "def_status")
    papers = node_papers.select(F.col("key").alias("of"), F.col("pid").alias("item"))
    return [
        Section("nodes", nodes, value, F.col("key"), F.col("key"), list_name="papers", items=papers, item_key=F.col("key")),
        Section("builds_on", edges, F.struct(F.col("src").alias("from"), F.col("dst").alias("to")),
                F.concat_ws("\u0000", "src", "dst")),
    ]


def draw_sections(nodes: DataFrame, links: DataFrame, sim_pairs: DataFrame, concept_papers: DataFrame) -> list[Section]:
    """Node, link and similarity arrays of the drawing; nodes list their papers
    (`concept_papers`: rk, pid)."""
    node = F.struct("id", "label", "def_status", "ptype", "has_def", "definition", "n_papers", "domain")
    papers = concept_papers.select(F.col("rk").alias("of"), F.col("pid").alias("item"))
    return [
        Section("nodes", nodes, node, F.col("id"), list_name="papers", items=papers, item_key=F.col("id")),
        Section("links", links, F.struct("source", "target", "kind", "from_type"),
                F.concat_ws("\u0000", "source", "target", "kind")),
        Section("sim_pairs", sim_pairs, F.struct("source", "target", "sim"),
                F.concat_ws("\u0000", "source", "target")),
    ]


# --- reading documents back ---------------------------------------------------------------

#: An entry of an object and a row of an array are lines of their own, so they are read by all tasks.
ENTRY = r'^,?("[^"\\]*+(?:\\.[^"\\]*+)*+"): (\{.*\})$'


def read_entries(spark: SparkSession, path: str, value: str) -> DataFrame:
    """at, key and the fields of `value` (DDL) of each entry whose object is one line; `at` is the order
    of the document, null fields are those that could not be read."""
    text = F.col("value")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line"))
    key = F.concat(F.lit('{"k":'), F.regexp_extract(text, ENTRY, 1), F.lit("}"))
    return lines.filter(text.rlike(ENTRY)).select(
        F.struct("file", "line").alias("at"), F.from_json(key, "k string")["k"].alias("key"),
        F.from_json(F.regexp_extract(text, ENTRY, 2), value).alias("v")).select("at", "key", "v.*")


def read_rows(spark: SparkSession, path: str, value: str) -> DataFrame:
    """The fields of `value` of each array row of the document that has the first of them: a line that is an
    object, after a comma or not. Generated rows are parsed once, as no filter is pushed below."""
    text = F.when(F.col("value").startswith(","), F.substring("value", 2, 2**31 - 1)).otherwise(F.col("value"))
    rows = spark.read.text(path).select(text.alias("value")).filter(F.col("value").startswith("{") & F.col("value").endswith("}"))
    return rows.select(F.inline(F.array(F.from_json("value", value)))).filter(F.col(value.split()[0].strip("`")).isNotNull())


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Lexicon rows of a document written from `lexicon_section`, in its order."""
    rows = read_entries(spark, path, "aliases array<string>, status string, definition string, source string, first_seen string")
    return with_row_index(rows, [F.col("at")], "ord").select("ord", F.col("key").alias("name"), "aliases", "status", "definition", "source", "first_seen")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger of a document written from `ledger_section`."""
    rows = read_entries(spark, path, LEDGER.split(", ", 1)[1])
    return rows.drop("at").withColumnRenamed("key", "aid")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """type (null in single-type graphs), from, to of a graph document."""
    return read_rows(spark, path, "`from` string, `to` string, type string").select("type", "from", "to")
