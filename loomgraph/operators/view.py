"""Concept view of the typed graph: nodes, derived lineage, paper overlay, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomgraph.functions.nodes import has_definition
from loomgraph.functions.text import arxiv_month, contains_text
from loomgraph.operators.graph_v2 import GraphV2
from loomgraph.operators.ordering import with_row_index
from loomgraph.schemas import DEFINES


def concept_papers(graph: GraphV2) -> DataFrame:
    """rk, pid: every paper that defines or builds on a concept, once. Papers are numbered
    in pid order, so listing by pid is listing by first occurrence."""
    return graph.edges.select("rk", "pid").distinct()


def concepts(graph: GraphV2) -> DataFrame:
    """Concept rows with paper count, earliest month, and the type and domain of the first
    paper that defines the concept. A hot concept is spread by (rk, pid) before it is
    counted."""
    pairs = graph.edges.groupBy("rk", "pid").agg(
        F.max(F.col("phase") == DEFINES).alias("defines")
    )
    per_rk = pairs.groupBy("rk").agg(
        F.count("*").alias("n_papers"),
        F.min(F.when(F.col("defines"), F.col("pid"))).alias("home"),
        F.min(arxiv_month("pid")).alias("month"),
    )
    home_meta = graph.papers.select(
        F.col("pid").alias("home"),
        F.nullif("paper_type", F.lit("")).alias("ptype"),
        F.nullif("domain", F.lit("")).alias("domain"),
    )
    return (
        graph.concepts.join(per_rk, "rk", "left")
        .join(home_meta, "home", "left")
        .select(
            F.col("rk").alias("id"),
            "canonical",
            "definition",
            "def_status",
            "status",
            F.coalesce("n_papers", F.lit(0)).alias("n_papers"),
            "month",
            F.coalesce("ptype", F.lit("technique")).alias("ptype"),
            F.coalesce("domain", F.lit("general")).alias("domain"),
        )
    )


def builds_on(graph: GraphV2) -> DataFrame:
    """Concept -> concept lineage: the first admitted concept a paper defines builds on
    each of the paper's targets. No self loops, one row per pair."""
    first = (
        graph.edges.filter(F.col("phase") == DEFINES)
        .groupBy("pid").agg(F.min(F.struct("pos", "rk")).alias("d"))
        .select("pid", F.col("d.rk").alias("src"))
    )
    targets = (
        graph.edges.filter(F.col("phase") != DEFINES)
        .select("pid", F.col("rk").alias("dst"))
    )
    return targets.join(first, "pid").filter("src <> dst").select("src", "dst").distinct()


def paper_nodes(graph: GraphV2) -> DataFrame:
    return graph.papers.select(
        F.concat(F.lit("paper:"), "pid").alias("id"), "title", "paper_type", "domain", "problem"
    )


def nodes_with_papers(graph: GraphV2) -> DataFrame:
    """Concept and paper nodes in one table; columns of the other kind are null."""
    return with_papers(concepts(graph), graph)


def with_papers(concept_nodes: DataFrame, graph: GraphV2) -> DataFrame:
    c = concept_nodes.withColumn("type", F.lit("concept"))
    p = paper_nodes(graph).withColumn("type", F.lit("paper"))
    return c.unionByName(p, allowMissingColumns=True)


def paper_defines(graph: GraphV2) -> DataFrame:
    """Paper -> concept define edges, duplicates kept."""
    return graph.edges.filter(F.col("phase") == DEFINES).select(
        F.concat(F.lit("paper:"), "pid").alias("src"), F.col("rk").alias("dst")
    )


def paper_anchors(graph: GraphV2) -> DataFrame:
    """Build edges of papers that have no define edge, duplicates kept."""
    defining = graph.edges.filter(F.col("phase") == DEFINES).select("pid")
    return (
        graph.edges.filter(F.col("phase") != DEFINES)
        .join(defining, "pid", "left_anti")
        .select(F.concat(F.lit("paper:"), "pid").alias("src"), F.col("rk").alias("dst"))
    )


# --- queries over the view ---------------------------------------------------------------


def filter_nodes(nodes: DataFrame, ptype: str | None = None, domain: str | None = None,
                 date_after: str | None = None) -> DataFrame:
    """AND of the given conditions; an unset or empty one is skipped. Undated nodes fail
    only when a date is asked for. Paper nodes are never selected."""
    if "type" in nodes.columns:
        nodes = nodes.filter("type = 'concept'")
    if ptype:
        nodes = nodes.filter(F.col("ptype") == ptype)
    if domain:
        nodes = nodes.filter(F.col("domain") == domain)
    if date_after:
        nodes = nodes.filter(F.col("month") >= date_after)
    return nodes


def search(nodes: DataFrame, query: str) -> DataFrame:
    """Concepts whose name contains the text; a blank query finds nothing."""
    if "type" in nodes.columns:
        nodes = nodes.filter("type = 'concept'")
    q = query.strip()
    hit = contains_text("canonical", q) if q else F.lit(False)
    return nodes.filter(hit).select("id", "canonical")


def next_match(count: int, current: int, repeated: bool) -> int:
    """Position of the match to show: advances cyclically while the query is repeated."""
    return (current + 1) % count if repeated and count > 1 else 0


def names(nodes: DataFrame) -> DataFrame:
    return nodes.select("canonical").orderBy("canonical")


def ranked_names(nodes: DataFrame) -> DataFrame:
    """rank, canonical: the position of every name in that order."""
    return with_row_index(nodes.select("canonical"), [F.col("canonical")], "rank").select("rank", "canonical")


def induced_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges whose both ends are among `ids` (a one-column table `id`)."""
    keep = ids.select("id").distinct()
    return edges.join(keep, edges["src"] == keep["id"], "left_semi").join(
        keep, edges["dst"] == keep["id"], "left_semi"
    )


def drop_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends exist."""
    return induced_edges(edges, nodes)


def links(edges: DataFrame, nodes: DataFrame, kind: str = "builds_on") -> DataFrame:
    """Drawable links: both ends exist; the link carries the type of its source."""
    src = nodes.select(F.col("id").alias("src"), F.coalesce("ptype", F.lit("technique")).alias("from_type"))
    dst = nodes.select(F.col("id").alias("dst"))
    return (
        edges.join(src, "src").join(dst, "dst", "left_semi")
        .select(F.col("src").alias("source"), F.col("dst").alias("target"),
                F.lit(kind).alias("kind"), "from_type")
    )


def export_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        "id", F.col("canonical").alias("label"), "def_status", "ptype",
        has_definition(F.col("def_status")).alias("has_def"), "definition", "n_papers", "domain",
    )
