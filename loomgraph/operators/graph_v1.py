"""Single-type graph: technique nodes, pseudo-nodes for papers that define none, lineage.

All defines are processed before all builds. Attributes are mins over (pid, pos), which
combine map-side, so a hot concept costs each task one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from loomgraph.functions.nodes import admitted, v1_def_status
from loomgraph.functions.text import or_empty
from loomgraph.operators import mentions as M
from loomgraph.operators.ordering import with_row_index
from loomgraph.schemas import BUILDS_ON, DEFINES


@dataclass
class GraphV1:
    nodes: DataFrame         # key, canonical, definition, def_source, domain, ptype, status, def_status, n_papers
    node_papers: DataFrame   # key, pid: defining papers, one row each
    edges: DataFrame         # src, dst
    blocked: DataFrame       # name, pid, pos, status: builds whose target is not admitted
    registered: DataFrame    # new lexicon rows


def undefined_papers(papers: DataFrame, mentions: DataFrame) -> DataFrame:
    """Papers that define nothing."""
    if "n_defines" in papers.columns:
        return papers.filter("n_defines = 0")
    defining = mentions.filter(F.col("phase") == DEFINES).select("pid")
    return papers.join(defining, "pid", "left_anti")


def build(papers: DataFrame, mentions: DataFrame, lexicon: DataFrame,
          resolved: M.Resolved | None = None) -> GraphV1:
    """All outputs read one table of resolved mentions, made here unless given."""
    r = resolved or M.resolve_mentions(mentions, lexicon, M.register_defines_first)
    admitted_names = r.names.filter(admitted(F.col("status")))
    ok = admitted_names.select("rk")
    define_papers = (
        r.rows.filter(F.col("phase") == DEFINES).select("rk", "pid").distinct()
        .join(ok, "rk", "left_semi").select(F.col("rk").alias("key"), "pid")
    )
    pseudo = undefined_papers(papers, r.rows)
    nodes = _concept_nodes(papers, r.rows, admitted_names).unionByName(_pseudo_nodes(pseudo))
    node_papers = define_papers.unionByName(
        pseudo.select(F.concat(F.lit("paper:"), "pid").alias("key"), "pid")
    )
    turned_down = r.names.filter(~admitted(F.col("status"))).select("rk", "status")
    return GraphV1(
        nodes=nodes.withColumn("def_status", v1_def_status(F.col("definition"), F.col("ptype"))),
        node_papers=node_papers,
        edges=_edges(r.rows, ok, pseudo),
        blocked=r.rows.filter(F.col("phase") == BUILDS_ON).join(turned_down, "rk").select(
            "name", "pid", "pos", "status"
        ),
        registered=r.registered,
    )


def _concept_nodes(papers, rows, names):
    """One aggregate per name: its first define and its number of defining papers, counted
    over (rk, pid) first; label, status and lexicon text are joined to the result."""
    defines = F.col("phase") == DEFINES
    pairs = rows.groupBy("rk", "pid").agg(
        F.min(F.when(defines, F.struct("pos", or_empty("definition").alias("definition")))).alias("d"))
    per_rk = pairs.groupBy("rk").agg(
        F.min(F.when(F.col("d").isNotNull(), F.struct("pid", "d"))).alias("d"), F.count("d").alias("n_papers"))
    meta = papers.select(F.col("pid").alias("def_source"), "domain", "paper_type")
    return (
        per_rk.join(names, "rk")
        .withColumn("def_source", F.col("d.pid"))
        .withColumn("written", F.nullif("d.d.definition", F.lit("")))
        .join(meta, "def_source", "left")
        .select(
            F.col("rk").alias("key"),
            F.col("label").alias("canonical"),
            F.coalesce("written", "lex_definition").alias("definition"),
            or_empty("def_source").alias("def_source"),
            F.coalesce("domain", F.lit("general")).alias("domain"),
            F.coalesce("paper_type", F.lit("technique")).alias("ptype"),
            "status",
            "n_papers",
        )
    )


def _pseudo_nodes(pseudo):
    return pseudo.select(
        F.concat(F.lit("paper:"), "pid").alias("key"),
        F.left(F.coalesce("title", "pid"), F.lit(40)).alias("canonical"),
        or_empty("problem").alias("definition"),
        F.col("pid").alias("def_source"),
        F.coalesce("domain", F.lit("general")).alias("domain"),
        F.coalesce("paper_type", F.lit("technique")).alias("ptype"),
        F.lit("approved").alias("status"),
        F.lit(1).cast("bigint").alias("n_papers"),
    )


def _edges(rows, ok, pseudo):
    """Home of a paper -> each admitted target, distinct. The home is the first name the
    paper defines, admitted or not; edges from a home without a node are dropped. Repeats of a
    target are left to the last aggregate, as dropping them before deals out every mention once more."""
    targets = rows.filter(F.col("phase") == BUILDS_ON).select("pid", "rk").join(ok, "rk", "left_semi")
    homes = (
        rows.filter(F.col("phase") == DEFINES)
        .groupBy("pid").agg(F.min(F.struct("pos", "rk")).alias("h"))
        .select("pid", F.col("h.rk").alias("rk")).join(ok, "rk", "left_semi")
        .select("pid", F.col("rk").alias("src"))
        .unionByName(pseudo.select("pid", F.concat(F.lit("paper:"), "pid").alias("src")))
    )
    return targets.join(homes, "pid").select("src", F.col("rk").alias("dst")).distinct()


def blocked_counts(blocked: DataFrame) -> DataFrame:
    """rank, name, n: how often each non-admitted name is built on, most frequent first, then
    by first occurrence."""
    counted = blocked.groupBy("name").agg(F.count("*").alias("n"), F.min(F.struct("pid", "pos")).alias("at"))
    return with_row_index(counted, [F.desc("n"), F.col("at")], "rank").select("rank", "name", "n")
