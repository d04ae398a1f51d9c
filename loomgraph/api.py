"""Facade over a store folder: the calls a user interface or script makes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomgraph.external import Embedder, embed_texts
from loomgraph.operators import graph_v2, lexicon as L, retrieval as R, similarity as S, vector_index as VI, vector_store as VS, view
from loomgraph.plans import commands, incremental
from loomgraph.plans.workflow import CollectWorkflow
from loomgraph.schemas import PAPERS, SCORE_FLOOR, TOP_K, VECTORS
from loomgraph.sources.records import dry_run
from loomgraph.sources.snapshots import Snapshots


@dataclass
class GraphView:
    nodes: DataFrame
    builds_on: DataFrame
    concept_papers: DataFrame
    defines: DataFrame | None = None
    paper_builds_on: DataFrame | None = None


@dataclass
class FieldSimilarity:
    pairs: DataFrame    # field, a, b, sim, node_pairs
    summary: DataFrame  # per field
    top: DataFrame      # field, a, b, sim


class Workbench:
    """Reads and edits the tables of one store. Edits write a new lexicon snapshot; the
    graph shows them after a rebuild."""

    def __init__(self, spark: SparkSession, root: str, workflow: CollectWorkflow | None = None,
                 translator: commands.Translator | None = None):
        self.store = Snapshots(spark, root)
        self.workflow, self.translator = workflow, translator

    # graph
    def _typed(self) -> graph_v2.GraphV2:
        r = self.store.read
        return graph_v2.GraphV2(r("v2_papers"), r("v2_concepts"), r("v2_edges"), registered=None)

    def graph(self, papers: bool = False) -> GraphView:
        g, r = self._typed(), self.store.read
        nodes = view.with_papers(r("view_nodes"), g) if papers else r("view_nodes")
        out = GraphView(nodes, r("view_builds_on"), view.concept_papers(g))
        if papers:
            out.defines, out.paper_builds_on = view.paper_defines(g), view.paper_anchors(g)
        return out

    def rebuild(self) -> dict:
        """Brings the graphs up to date, by the new papers alone where that is enough."""
        incremental.rebuild_stored(self.store)
        return {"ok": True, "nodes": self.store.read("view_nodes").count(),
                "builds_on": self.store.read("view_builds_on").count()}

    def refresh_vectors(self, embedder: Embedder, force: bool = False) -> DataFrame:
        """Grows the stored vectors of the typed graph; returns counts per node type."""
        g = self._typed()
        store = self.store.read("vectors", VECTORS)
        return VS.summary(self.store.write("vectors", VS.refresh(VS.v2_texts(g.concepts, g.papers), store, embedder, force)))

    def index_vectors(self, node_type: str, **fitting) -> None:
        """Builds the index of the stored vectors of one node type; tables and quantizer change together."""
        vectors = R.split_by_type(self.store.read("vectors", VECTORS), node_type).select("id", "vec")
        with self.store.commit() as c:
            built = VI.index(vectors, lambda _, df: c.write(f"index_{node_type}", df), **fitting)
            c.write(f"quantizer_{node_type}", built.quantizer.to_frame(self.store.spark))

    def match_many(self, queries: DataFrame, node_type: str, top: int = TOP_K, floor: float = SCORE_FLOOR, exact: bool = False) -> DataFrame:
        """qid, rank, id, score for each (qid, vec), through the index of the node type."""
        quantizer = VI.Quantizer.from_frame(self.store.read(f"quantizer_{node_type}"))
        return VI.search(VI.VectorIndex(quantizer, self.store.read(f"index_{node_type}")), queries, top, floor, exact)

    def sample(self, n: int = 3) -> DataFrame:
        """The first stored papers in id order, to look at before a full run."""
        return dry_run(self.store.read("papers", PAPERS), n)

    def similarity(self, contents: DataFrame, embedder: Embedder, floor: float = -1.0, top: int = 5) -> FieldSimilarity:
        """Pairs of content records per text field, stored as `similarity`, with summary and best pairs."""
        texts = S.long_fields(S.field_texts(contents))
        keyed = texts.select(F.struct("field", "id").alias("id"), "text")
        vectors = self.store.write("field_vectors", embed_texts(keyed, embedder).select("id.field", "id.id", "vec"))
        pairs = self.store.write("similarity", S.pairs(vectors, floor))
        return FieldSimilarity(pairs, S.stats(vectors), S.top_pairs(vectors, top))

    # lexicon
    def lexicon(self) -> DataFrame:
        return L.rows(self.store.read("lexicon"))

    def patch_lexicon(self, name: str, changes: dict) -> dict:
        edited = self.store.write("lexicon", L.patch(self.store.read("lexicon"), name, changes))
        row = edited.filter(edited["name"] == name).drop("ord").first().asDict()
        return {"ok": True, **row}

    def merge_lexicon(self, src: str, into: str) -> dict:
        edited = self.store.write("lexicon", L.merge(self.store.read("lexicon"), src, into))
        aliases = edited.filter(edited["name"] == into).first()["aliases"]
        return {"ok": True, "into": into, "aliases": aliases}

    def classify_pending(self, plan: DataFrame, apply: bool = False) -> DataFrame:
        """Status counts after a validated bulk change; without `apply`, a dry run."""
        out = L.bulk_classify(self.store.read("lexicon"), plan, apply, skip_non_pending=True)
        return L.status_counts(self.store.write("lexicon", out) if apply else out)

    # commands
    def command(self, text: str) -> dict:
        """Translates a sentence to a checked tool call."""
        if not (text or "").strip():
            raise L.LexiconError("bad_request", "the command is empty")
        nodes = self.graph().nodes
        call = self.translator.translate(text.strip(), view.names(nodes))
        return commands.checked_call(call, nodes)

    def resume(self, thread_id: str, decision: str) -> dict:
        """Takes a collection run to its next question."""
        return self.workflow.resume(thread_id, decision)

    def run(self, request: commands.Request) -> commands.CommandResult | dict:
        if isinstance(request, commands.CollectRequest):
            return self.workflow.start(request.topic_text)
        g = self.graph()
        return commands.run(request, g.nodes, g.builds_on)
