"""Registered queries: each runs operators over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomgraph.external import HashingEmbedder, KeywordClassifier, embed_texts
from loomgraph.functions import nodes as N, text as X, vectors as V
from loomgraph.operators import (
    collect as C, graph_v1, graph_v2, lexicon as L, lineage as G, mentions as M,
    papertext as P, retrieval as R, similarity as S, vector_index as VI, vector_store as VS, view,
)
from loomgraph.operators.closures import closure_counts
from loomgraph.operators.ordering import with_row_index
from loomgraph.plans import decisions, incremental
from loomgraph.plans.rebuild import rebuild
from loomgraph.plans.tables import Tables
from loomgraph.schemas import LEDGER
from loomgraph.session import Scratch, materialize, ship_package
from loomgraph.sources import documents as D
from loomgraph.sources.snapshots import Snapshots

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return fn(Tables(spark, folder))

    run.__doc__ = fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def _new_folder(t: Tables) -> Snapshots:
    """An empty store under the shared checkpoint folder."""
    return Snapshots(t.spark, Scratch(t.spark).root)


def _v1(t: Tables) -> graph_v1.GraphV1:
    return graph_v1.build(t.papers(), t.mentions(), t.lexicon())


def _v2(t: Tables) -> graph_v2.GraphV2:
    return graph_v2.build(t.papers(), t.mentions(), t.lexicon())


# --- names and lexicon ----------------------------------------------------------------


@query
def canon_names(t: Tables) -> DataFrame:
    names = t.part.select(F.expr("concat('  ', p_brand, '-', p_name, '  ', p_type)").alias("name")).unionByName(
        t.customer.select(F.expr("concat(c_name, '-', c_mktsegment)").alias("name"))
    ).unionByName(t.region.select(F.col("r_name").alias("name")))
    return names.groupBy(X.canon("name").alias("key")).agg(F.count("*").alias("n"))


@query
def alias_resolve(t: Tables) -> DataFrame:
    names = t.mentions().select("name", "pid")
    return L.resolve(names, t.lexicon()).groupBy("rk", "label", "status", "found").agg(
        F.count("*").alias("n")
    )


@query
def lexicon_rows(t: Tables) -> DataFrame:
    return L.rows(t.lexicon()).withColumn("aliases", F.array_join("aliases", "|"))


@query
def lexicon_register_v1(t: Tables) -> DataFrame:
    return _v1(t).registered.drop("at")


@query
def lexicon_register_v2(t: Tables) -> DataFrame:
    return _v2(t).registered.drop("at")


@query
def registration_counts(t: Tables) -> DataFrame:
    return M.registration_counts(_v1(t).registered)


@query
def lexicon_after_rebuild(t: Tables) -> DataFrame:
    g = _v1(t)
    return L.append_registrations(t.lexicon(), g.registered, known=True).select(
        "ord", "name", "status", "definition", "source", "first_seen"
    )


@query
def status_counts(t: Tables) -> DataFrame:
    return L.status_counts(t.lexicon())


@query
def lexicon_sorted(t: Tables) -> DataFrame:
    return L.ranked_by(L.with_status(t.lexicon(), "pending"), "source", "desc").select(
        "rank", "name", "source", "ord"
    )


@query
def lexicon_search(t: Tables) -> DataFrame:
    return L.highlighted(t.lexicon(), " RT-1 ").groupBy("status", "matched").agg(F.count("*").alias("n"))


@query
def lexicon_patch(t: Tables) -> DataFrame:
    patches = t.supplier.select(
        F.expr("concat('Part-', s_suppkey % 40 + 1)").alias("name"), F.col("s_suppkey").alias("seq"),
        F.expr("case when s_acctbal < 5000 then 'approved' end").alias("status"),
        F.col("s_name").alias("definition"),
    )
    return L.patch_many(t.lexicon(), patches).select("name", "status", "definition", "source")


@query
def lexicon_merge(t: Tables) -> DataFrame:
    """Chains of merges with several sources per target; aliases as rows."""
    merges = t.customer.select(
        F.expr("concat('Part-', c_custkey + 25)").alias("src"),
        F.expr("concat('Part-', (c_custkey + 25) div 5)").alias("dst"),
        F.col("c_custkey").alias("seq"),
    )
    return L.merged_aliases(t.lexicon(), merges)


def _plan(t: Tables) -> DataFrame:
    """A made-up plan: all pending names and those of one size that is not pending."""
    return t.part.filter("p_size between 36 and 42 or p_size = 50").select(
        F.expr("concat('Part-', p_partkey)").alias("name"),
        F.expr("case when p_retailprice < 1000 then 'approve' else 'reject' end").alias("action"),
        F.lit(None).cast("string").alias("into"),
    )


@query
def bulk_plan_check(t: Tables) -> DataFrame:
    """A plan that leaves one name out."""
    found = L.plan_differences(t.lexicon(), _plan(t).filter("name <> 'Part-1'"))
    return with_row_index(found, [F.col("problem"), F.col("name")], "rank")


@query
def bulk_classify(t: Tables) -> DataFrame:
    """Statuses and aliases after a plan that folds the names of one size into one target."""
    goal = t.part.filter("p_size = 20").agg(F.min("p_partkey").cast("string")).scalar()
    merges = t.part.filter("p_size = 42").select(
        F.expr("concat('Part-', p_partkey)").alias("name"), F.lit("merge").alias("action"), F.concat(F.lit("Part-"), goal).alias("into"))
    rest = _plan(t).join(merges.select("name"), "name", "left_anti")
    return L.plan_outcome(t.lexicon(), rest.unionByName(merges), skip_non_pending=True)


@query
def alias_edit(t: Tables) -> DataFrame:
    grown = L.add_alias(F.col("aliases"), F.expr("concat(' maker ', p_size, ' ')"))
    other = L.add_alias(F.col("aliases"), F.col("source"))
    lex = t.lexicon().join(t.part.select(F.col("p_partkey").alias("ord"), "p_size"), "ord")
    return lex.select(
        "name",
        F.array_join(grown, "|").alias("same"),
        F.array_join(other, "|").alias("added"),
        F.array_join(L.remove_alias(F.col("aliases"), F.expr("concat('maker ', p_size)")), "|").alias("removed"),
    )


# --- graphs -----------------------------------------------------------------------------


@query
def graph_v1_nodes(t: Tables) -> DataFrame:
    return _v1(t).nodes


@query
def graph_v1_node_papers(t: Tables) -> DataFrame:
    return _v1(t).node_papers


@query
def graph_v1_edges(t: Tables) -> DataFrame:
    return _v1(t).edges


@query
def blocked_refs(t: Tables) -> DataFrame:
    return graph_v1.blocked_counts(_v1(t).blocked)


@query
def graph_v2_concepts(t: Tables) -> DataFrame:
    return _v2(t).concepts


@query
def graph_v2_papers(t: Tables) -> DataFrame:
    return _v2(t).papers.withColumn("task", F.array_join("task", "|"))


@query
def graph_v2_edges(t: Tables) -> DataFrame:
    return _v2(t).edges.groupBy("pid", "type", "rk").agg(F.count("*").alias("n"))


@query
def graph_v2_counts(t: Tables) -> DataFrame:
    return graph_v2.counts(_v2(t))


@query
def rebuild_counts(t: Tables) -> DataFrame:
    return rebuild(t.papers(), t.mentions(), t.lexicon()).counts()


# --- view ---------------------------------------------------------------------------------


@query
def view_concepts(t: Tables) -> DataFrame:
    return view.concepts(_v2(t))


@query
def view_concept_papers(t: Tables) -> DataFrame:
    return view.concept_papers(_v2(t))


@query
def view_builds_on(t: Tables) -> DataFrame:
    """Which concepts does each paper's main concept build on?"""
    return view.builds_on(_v2(t))


def _followed(t: Tables) -> Snapshots:
    """The stored graphs after a rebuild of three quarters of the papers and the delta of the rest."""
    store, papers, mentions = _new_folder(t), t.papers(), t.mentions()
    later = F.pmod(F.xxhash64("pid"), F.lit(4)) == 0
    incremental.apply(store, papers.filter(~later), mentions.filter(~later), t.lexicon(), full=True, buckets=4)
    incremental.apply(store, papers.filter(later), mentions.filter(later), store.read("lexicon"), full=False)
    return store


@query
def rebuild_counts_delta(t: Tables) -> DataFrame:
    store = _followed(t)
    nodes = store.read("view_nodes").agg(F.count("*").alias("nodes"))
    return nodes.withColumn("builds_on", store.read("view_builds_on").agg(F.count("*")).scalar())


@query
def graph_v1_nodes_delta(t: Tables) -> DataFrame:
    return _followed(t).read("v1_nodes")


@query
def graph_v1_edges_delta(t: Tables) -> DataFrame:
    return _followed(t).read("v1_edges")


@query
def view_nodes_by_type(t: Tables) -> DataFrame:
    return view.nodes_with_papers(_v2(t)).groupBy("type", "domain").agg(
        F.count("*").alias("n"), F.count("title").alias("titled"), F.count("canonical").alias("named")
    )


@query
def view_paper_defines(t: Tables) -> DataFrame:
    return view.paper_defines(_v2(t)).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query
def view_paper_anchors(t: Tables) -> DataFrame:
    return view.paper_anchors(_v2(t)).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query
def graph_filter(t: Tables) -> DataFrame:
    return view.filter_nodes(view.concepts(_v2(t)), "technique", "medical", "2010-05").select(
        "id", "canonical", "month"
    )


@query
def concept_search(t: Tables) -> DataFrame:
    return view.search(view.concepts(_v2(t)), " RT-12 ")


@query
def concept_names(t: Tables) -> DataFrame:
    return view.ranked_names(_v2(t).concepts)


@query
def induced_subgraph(t: Tables) -> DataFrame:
    g = _v2(t)
    picked = materialize(view.filter_nodes(view.concepts(g), domain="general").select("id"))  # for both ends
    return view.induced_edges(view.builds_on(g), picked)


@query
def graph_links(t: Tables) -> DataFrame:
    g = _v2(t)
    nodes = materialize(view.concepts(g).select("id", "ptype"))  # for both ends
    return view.links(view.builds_on(g), nodes)


@query
def graph_export_nodes(t: Tables) -> DataFrame:
    return view.export_nodes(view.concepts(_v2(t)))


def _lineage(t: Tables, direction: str) -> DataFrame:
    """Closure around the concept with the most targets."""
    edges = materialize(view.builds_on(_v2(t)))  # the start and the walk read it
    most = edges.groupBy("src").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src").limit(1)
    return G.closure(edges, most.select(F.col("src").alias("id")), direction)


@query
def lineage_ancestors(t: Tables) -> DataFrame:
    return _lineage(t, "ancestors")


@query
def lineage_descendants(t: Tables) -> DataFrame:
    return _lineage(t, "descendants")


@query
def lineage_both(t: Tables) -> DataFrame:
    return _lineage(t, "both").groupBy("id").agg(F.count("*").alias("sides"))


@query
def lineage_counts(t: Tables) -> DataFrame:
    """How many ancestors and descendants the concept with the most targets has."""
    return G.side_counts(_lineage(t, "both"))


@query
def lineage_all_counts(t: Tables) -> DataFrame:
    """How many ancestors and descendants every concept has."""
    return closure_counts(view.builds_on(_v2(t)))


# --- texts and vectors ------------------------------------------------------------------


@query
def node_texts(t: Tables) -> DataFrame:
    nodes = _v1(t).nodes
    return VS.v1_texts(nodes)


@query
def embed_texts_v2(t: Tables) -> DataFrame:
    g = _v2(t)
    return VS.v2_texts(g.concepts, g.papers)


@query
def text_fallbacks(t: Tables) -> DataFrame:
    return VS.fallback_count(_v1(t).nodes)


def _contents(t: Tables) -> DataFrame:
    """Parts as content records: the brand is the defined name, promoted parts define none."""
    return t.part.select(
        F.col("p_partkey").alias("pid"),
        F.expr("concat(p_name, ' number ', p_partkey)").alias("title"),
        F.split("p_name", " ").alias("task"),
        F.expr("case when p_type = 'PROMO' then array() else array(named_struct('name', p_brand, "
               "'definition', concat(p_name, ' ', p_size))) end").cast(
            "array<struct<name:string,definition:string>>").alias("defines"),
        F.expr("case when p_size > 25 then p_type else '' end").alias("problem"),
    )


@query
def records_to_mentions(t: Tables) -> DataFrame:
    """Content and lineage records as mentions; a part builds on the words of its name."""
    contents = _contents(t)
    return M.from_records(contents, contents.select("pid", F.col("task").alias("builds_on")))


@query
def defined_name_lists(t: Tables) -> DataFrame:
    return _contents(t).select("pid", X.defined_names("defines").alias("names"))


@query
def plain_ids(t: Tables) -> DataFrame:
    g = _v2(t)
    return VS.v2_texts(g.concepts, g.papers).select("id", X.strip_prefix("id").alias("plain"))


@query
def text_skips(t: Tables) -> DataFrame:
    g = _v2(t)
    return VS.skipped_count(VS.v2_texts(g.concepts, g.papers))


@query
def field_texts_of_graph(t: Tables) -> DataFrame:
    """Field texts of the names that are nodes, here the brands of small parts."""
    return S.field_texts(_contents(t), t.part.filter("p_size <= 20").select(X.canon("p_brand").alias("key")).distinct())


@query
def field_texts(t: Tables) -> DataFrame:
    return S.field_texts(_contents(t))


@query
def field_similarity(t: Tables) -> DataFrame:
    """Similarity summary per text field, over offline embeddings of the texts."""
    texts = S.long_fields(S.field_texts(_contents(t)))
    keyed = texts.select(F.struct("field", "id").alias("id"), "text")
    vectors = embed_texts(keyed, HashingEmbedder()).select("id.field", "id.id", "vec")
    return S.stats(vectors).withColumns({c: F.round(c, 6) for c in ("mean_sim", "median_sim")})


def _new_store(t: Tables, texts: DataFrame) -> DataFrame:
    empty = t.spark.createDataFrame([], "model string, id string, vec array<double>")
    return VS.refresh(texts, empty, HashingEmbedder())


def _ends() -> Column:
    """Sum of the first and last elements, a figure of the whole store."""
    return F.round(F.sum(F.col("vec")[0]) + F.sum(F.col("vec")[63]), 6).alias("ends")


@query
def node_vectors(t: Tables) -> DataFrame:
    """Vector store of the typed graph, built from nothing."""
    g = _v2(t)
    store = _new_store(t, VS.v2_texts(g.concepts, g.papers))
    return store.groupBy(F.substring_index("id", ":", 1).alias("type")).agg(
        F.count("*").alias("n"), F.max(F.size("vec")).cast("bigint").alias("dim"), F.round(F.sum(V.dot("vec", "vec")), 3).alias("norms"), _ends())


@query
def node_vectors_v1(t: Tables) -> DataFrame:
    """Vector store of the single-type graph, built from nothing."""
    store = _new_store(t, VS.v1_texts(_v1(t).nodes))
    return store.agg(F.count("*").alias("n"), F.max(F.size("vec")).cast("bigint").alias("dim"), _ends())


@query
def vector_incremental(t: Tables) -> DataFrame:
    texts = t.documents.select(F.col("doc_id").alias("id"), F.nullif(X.strip("text"), F.lit("")).alias("text"))
    store = t.embeddings.select(
        F.expr("case when label < 7 then 'm1' else 'm0' end").alias("model"), F.col("vec_id").alias("id")
    )
    return VS.batch_numbers(VS.todo(texts, store, "m1").select("id"))


@query
def similarity_stats(t: Tables) -> DataFrame:
    out = S.stats(t.vectors())
    return out.select("field", "pairs", *[F.round(c, 6).alias(c) for c in (
        "min_sim", "mean_sim", "median_sim", "max_sim")])


@query
def similarity_top(t: Tables) -> DataFrame:
    """Best pairs of each field; every label is a field."""
    return S.top_pairs(t.vectors().withColumn("field", F.concat(F.lit("label "), "label")), 5)


@query
def similarity_pairs(t: Tables) -> DataFrame:
    return S.pairs(t.vectors(), 0.30)


@query
def similarity_family(t: Tables) -> DataFrame:
    names = "array('small ring', 'BOLT 3', 'plate', 'ring bolt', 'nut')"
    labels = t.vectors().withColumn("label", F.expr(f"{names}[label % 5]"))
    return S.pairs(S.family(labels, ["Ring", "bolt"]), 0.20)


@query
def similarity_overlay(t: Tables) -> DataFrame:
    papers = t.vectors().select(F.col("id").alias("key"), F.col("label").alias("pid"))
    return S.overlay(t.vectors(), papers, 0.30)


def _query_vector(t: Tables) -> list[float]:
    return t.vectors().orderBy("id").first()["vec"]


@query
def vector_topk(t: Tables) -> DataFrame:
    hits = R.match_each(t.vectors().drop("field"), _query_vector(t), "label")
    return hits.select("label", "rank", "id", F.round("score", 6).alias("score"))


def _indexed(t: Tables) -> tuple[VI.VectorIndex, DataFrame]:
    """An index of all vectors, and the stated queries: every id divisible by 100."""
    vectors = t.vectors().select("id", "vec")
    return VI.index(vectors, Scratch(t.spark).write), vectors.filter("id % 100 = 0").withColumnRenamed("id", "qid")


@query
def vector_index_exact(t: Tables) -> DataFrame:
    """Best rows of every stated query, by comparing all blocks."""
    hits = VI.search(*_indexed(t), exact=True)
    return hits.withColumn("score", F.round("score", 6))


@query
def vector_index_recall(t: Tables) -> DataFrame:
    """Does the index find nine tenths of the best rows of the stated queries?"""
    index, asked = _indexed(t)
    share = VI.recall_of(VI.search(index, asked), VI.search(index, asked, exact=True))
    return share.select("n", (F.col("share") >= 0.9).alias("enough"))


@query
def vector_cosine(t: Tables) -> DataFrame:
    score = V.score_against(_query_vector(t))
    return t.vectors().select("id", V.round3(score("vec")).alias("sim"))


def _hits(t: Tables) -> tuple[DataFrame, DataFrame]:
    q = _query_vector(t)
    v = t.vectors().drop("field")
    return (
        R.match(v.filter("label < 5").drop("label"), q),
        R.match(v.filter("label >= 5").drop("label"), q),
    )


def _hit_nodes(t: Tables) -> tuple[DataFrame, DataFrame]:
    concepts = t.part.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("canonical"),
        F.expr("case when p_size > 25 then p_type else ' ' end").alias("definition"),
        F.expr("case when p_type = 'PROMO' then 'placeholder' else 'ok' end").alias("def_status"),
    )
    papers = t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"),
        F.expr("case o_orderstatus when 'P' then '' else o_orderstatus end").alias("problem"),
    )
    return concepts, papers


@query
def related_terms(t: Tables) -> DataFrame:
    c, p = _hit_nodes(t)
    ch, ph = _hits(t)
    return R.related_terms(ch, ph, c, p).select("side", "id", "term")


@query
def status_lines(t: Tables) -> DataFrame:
    c, p = _hit_nodes(t)
    ch, ph = _hits(t)
    return R.concept_lines(ch, c).unionByName(R.paper_lines(ph, p)).select("id", "line")


# --- collection -------------------------------------------------------------------------


@query
def query_dedup(t: Tables) -> DataFrame:
    spelled = t.customer.select(
        F.col("c_custkey").alias("ord"),
        F.expr("case when c_acctbal < 0 then '  ' when c_acctbal < 5000 then "
               "concat(' ', lower(c_mktsegment), ' ') else concat(c_mktsegment, ' ', c_nationkey) end"
               ).alias("query"),
    )
    return C.dedup_queries(spelled)


@query
def paper_search(t: Tables) -> DataFrame:
    return C.search_results(t.feed(), "2024-03", "2025-06").withColumn(
        "categories", F.array_join("categories", "|")
    )


@query
def search_page(t: Tables) -> DataFrame:
    """What a service that returns pages of 50, newest first, gives for each query."""
    return C.newest_per_query(t.feed()).select("query_ord", "rank", "entry_ord")


@query
def paper_months(t: Tables) -> DataFrame:
    """Hits per normalized id and arXiv month."""
    aid = X.normalize_paper_id("id")
    return t.feed().groupBy(aid.alias("aid"), X.arxiv_month(aid).alias("month")).agg(
        F.count("*").alias("n"), F.min(X.year_month("published")).alias("first_published")
    )


@query
def candidate_funnel(t: Tables) -> DataFrame:
    owned = t.conversations.select(F.col("conv_id").cast("string").alias("aid"))
    return C.funnel(C.judged(t.found(), owned, t.ledger()))


@query
def candidate_ids(t: Tables) -> DataFrame:
    owned = t.conversations.select(F.col("conv_id").cast("string").alias("aid"))
    return C.new_candidates(C.judged(t.found(), owned, t.ledger())).select("aid", "title")


def _ledger_columns(ledger: DataFrame) -> DataFrame:
    return ledger.select(
        "aid", "title", F.length("abstract").cast("bigint").alias("abstract_chars"), "published",
        F.array_join("categories", "|").alias("categories"),
        F.col("gate.verdict").alias("verdict"), "extracted", "first_seen_query",
    )


@query
def ledger_upsert(t: Tables) -> DataFrame:
    return _ledger_columns(C.upsert_ledger(t.ledger(), t.found()))


@query
def ledger_upsert_stored(t: Tables) -> DataFrame:
    """The same through a stored, bucketed table; the second batch is a replay."""
    store = _new_folder(t)
    found = t.found()
    store.upsert("ledger", t.ledger(), "aid", lambda old, new: old.unionByName(new), LEDGER)
    for batch in (found.filter("first_seen_query = 'en'"), found, found.filter("first_seen_query = 'fr'")):
        store.upsert("ledger", batch, "aid", C.upsert_ledger, LEDGER)
    return _ledger_columns(store.read("ledger"))


# --- documents, written and read back ------------------------------------------------------


def _document(t: Tables, sections: list[D.Section]) -> str:
    path = f"{Scratch(t.spark).root}/document"
    D.write_document(t.spark, path, sections)
    return path


@query
def lexicon_document(t: Tables) -> DataFrame:
    rows = D.read_lexicon(t.spark, _document(t, D.lexicon_section(t.lexicon())))
    return rows.withColumn("aliases", F.array_join("aliases", "|"))


@query
def lexicon_stored(t: Tables) -> DataFrame:
    """A snapshot rebuilt from itself."""
    store = _new_folder(t)
    store.write("lexicon", t.lexicon().filter("ord % 2 = 0"))
    store.write("lexicon", store.read("lexicon").unionByName(t.lexicon().filter("ord % 2 = 1")))
    return L.rows(store.read("lexicon")).withColumn("aliases", F.array_join("aliases", "|"))


@query
def ledger_document(t: Tables) -> DataFrame:
    ledger = C.upsert_ledger(t.ledger(), t.found())
    return _ledger_columns(D.read_ledger(t.spark, _document(t, D.ledger_section(ledger))))


@query
def graph_v1_document(t: Tables) -> DataFrame:
    g = _v1(t)
    edges = D.read_edges(t.spark, _document(t, D.graph_v1_sections(g.nodes, g.edges, g.node_papers)))
    return edges.select(F.col("from").alias("src"), F.col("to").alias("dst"))


@query
def graph_v2_document(t: Tables) -> DataFrame:
    g = _v2(t)
    edges = D.read_edges(t.spark, _document(t, D.graph_v2_sections(g.papers, g.concepts, g.edges)))
    return edges.groupBy(X.strip_prefix("from").alias("pid"), "type", X.strip_prefix("to").alias("rk")).agg(F.count("*").alias("n"))


RULES = {"survey": ["thing"], "benchmark": ["eaux"], "analysis": ["inth"]}


def _gate(t: Tables) -> C.GateOutcome:
    ledger = C.upsert_ledger(t.ledger(), t.found())
    return C.run_gate(ledger, t.found(), KeywordClassifier(RULES), "gate-v1", "2024-06-01")


@query
def gate_verdicts(t: Tables) -> DataFrame:
    return _gate(t).results


@query
def gate_ledger(t: Tables) -> DataFrame:
    return _gate(t).ledger.groupBy("gate.verdict", "gate.model", "gate.prompt_ver", "gate.date").agg(
        F.count("*").alias("n")
    )


@query
def gate_funnel(t: Tables) -> DataFrame:
    return C.gate_funnel(_gate(t).results)


@query
def metadata_complete(t: Tables) -> DataFrame:
    return C.completeness(t.found())


@query
def url_ids(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.normalize_paper_id("url").alias("aid"))


@query
def page_titles(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.squeeze(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)).alias("title"))


@query
def page_window(t: Tables) -> DataFrame:
    return P.leading_pages(t.line_pages()).groupBy("paper_id").agg(
        F.count("*").alias("pages"), F.max("page").alias("last_page"),
        F.sum(F.length("text")).alias("chars"),
    )


@query
def paper_texts(t: Tables) -> DataFrame:
    return P.full_texts(t.line_pages()).select("paper_id", F.md5("full").alias("digest"))


@query
def text_cut(t: Tables) -> DataFrame:
    """Whole texts, without page budget or head."""
    out = P.parsed(P.full_texts(t.talk_pages(), None), head=None)
    return out.select("paper_id", "ok", "cut_method", "char_count", F.md5("text").alias("digest"))


@query
def document_cut(t: Tables) -> DataFrame:
    cut = t.documents.select("doc_id", X.find_cut("text").alias("cut"))
    return cut.select("doc_id", "cut.cut_method", F.md5("cut.text").alias("digest"))


@query
def workflow_trace(t: Tables) -> DataFrame:
    log = t.conversations.select(
        "conv_id", "turn",
        F.expr("case role when 'user' then 'interpret' when 'assistant' then 'approve' "
               "else 'extract_confirm' end").alias("stage"),
        F.expr("case when length(text) > 600 then 'proceed' when length(text) > 300 then "
               "concat('revise: ', left(text, 10)) else 'cancel' end").alias("decision"),
    )
    return log.select(
        "conv_id", "turn", "stage",
        decisions.next_step_column(F.col("stage"), F.col("decision")).alias("next"),
        decisions.next_step_column(F.col("stage"), F.col("decision"), True).alias("next_strict"),
        decisions.revised_query(F.col("decision")).alias("revised"),
    )
