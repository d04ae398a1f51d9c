"""Typed graph: paper nodes, concept nodes, paper->concept edges (a bag, not a set)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from loomgraph.functions.nodes import admitted
from loomgraph.functions.text import or_empty
from loomgraph.operators import mentions as M
from loomgraph.schemas import DEFINES


@dataclass
class GraphV2:
    papers: DataFrame      # pid, title, problem, task, domain, paper_type
    concepts: DataFrame    # rk, canonical, definition, def_status, status
    edges: DataFrame       # pid, phase, pos, type, rk
    registered: DataFrame  # new lexicon rows


def build(papers: DataFrame, mentions: DataFrame, lexicon: DataFrame,
          resolved: M.Resolved | None = None) -> GraphV2:
    """Mentions count only for papers that have a content record. All outputs read one table
    of resolved mentions, made here unless given."""
    if resolved is None:
        r = M.resolve_mentions(M.of_records(mentions, papers), lexicon, M.register_in_order)
        rows = r.rows
    else:
        r = resolved
        rows = M.of_records(r.rows, papers)
    names = r.names.filter(admitted(F.col("status")))
    admitted_rows = rows.join(names.select("rk"), "rk", "left_semi")
    edges = admitted_rows.select(
        "pid", "phase", "pos",
        F.when(F.col("phase") == DEFINES, "defines").otherwise("builds_on").alias("type"),
        "rk",
    )
    return GraphV2(
        papers=papers.select(
            "pid",
            F.coalesce("title", "pid").alias("title"),
            or_empty("problem").alias("problem"),
            F.coalesce("task", F.array().cast("array<string>")).alias("task"),
            F.coalesce("domain", F.lit("general")).alias("domain"),
            F.coalesce("paper_type", F.lit("other")).alias("paper_type"),
        ),
        concepts=_concepts(rows, names),
        edges=edges,
        registered=r.registered,
    )


def _concepts(rows, names):
    """First non-empty definition in event order; `ok` once any paper defines the concept
    with text, or when its first event is a define."""
    written = (F.col("phase") == DEFINES) & F.col("definition").isNotNull()
    per_rk = rows.groupBy("rk").agg(
        F.min(F.struct("pid", "phase")).alias("first"),
        F.min(F.when(written, F.struct("pid", "pos", "definition"))).alias("text"),
    )
    ok = F.col("text").isNotNull() | (F.col("first.phase") == DEFINES)
    return per_rk.join(names, "rk").select(
        "rk",
        F.col("label").alias("canonical"),
        or_empty("text.definition").alias("definition"),
        F.when(ok, "ok").otherwise("placeholder").alias("def_status"),
        "status",
    )


def counts(graph: GraphV2) -> DataFrame:
    """Node, edge and placeholder counts, one row per kind."""
    kinds = [
        graph.papers.select(F.lit("papers").alias("kind")),
        graph.concepts.select(F.lit("concepts").alias("kind")),
        graph.concepts.filter("def_status = 'placeholder'").select(F.lit("placeholders").alias("kind")),
        graph.edges.select(F.col("type").alias("kind")),
    ]
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out.groupBy("kind").agg(F.count("*").alias("n"))
