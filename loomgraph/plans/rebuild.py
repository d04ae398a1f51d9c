"""Rebuild: single-type graph, grown lexicon, typed graph on that lexicon, view."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from loomgraph.operators import graph_v1, graph_v2, lexicon as L, mentions as M, view
from loomgraph.sources.snapshots import Snapshots


@dataclass
class Rebuilt:
    lexicon: DataFrame
    v1: graph_v1.GraphV1
    v2: graph_v2.GraphV2

    def counts(self) -> DataFrame:
        """Nodes and lineage edges of the concept view."""
        n = self.v2.concepts.agg(F.count("*").alias("nodes"))
        return n.withColumn("builds_on", view.builds_on(self.v2).agg(F.count("*")).scalar())


def rebuild(papers: DataFrame, mentions: DataFrame, lexicon: DataFrame,
            store: Snapshots | None = None) -> Rebuilt:
    """Mentions are resolved once for both graphs. With a store, the grown lexicon, every graph
    table and the view become new snapshots."""
    resolved = M.resolve_mentions(mentions, lexicon, M.register_defines_first)
    v1 = graph_v1.build(papers, mentions, lexicon, resolved)
    grown = L.append_registrations(lexicon, v1.registered, known=True)
    if store is not None:
        grown = store.write("lexicon", grown)
    # the grown lexicon resolves every mention to the same name and status, and leaves none to register
    resolved = M.Resolved(resolved.rows, resolved.names, resolved.registered.limit(0))
    v2 = graph_v2.build(papers, mentions, grown, resolved)
    if store is not None:
        v1.nodes = store.write("v1_nodes", v1.nodes)
        v1.node_papers = store.write("v1_node_papers", v1.node_papers)
        v1.edges = store.write("v1_edges", v1.edges)
        v2.papers = store.write("v2_papers", v2.papers)
        v2.concepts = store.write("v2_concepts", v2.concepts)
        v2.edges = store.write("v2_edges", v2.edges)
        store.write("view_nodes", view.concepts(v2))
        store.write("view_builds_on", view.builds_on(v2))
    return Rebuilt(grown, v1, v2)
