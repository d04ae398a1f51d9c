"""Properties of physical plans that keep queries within bounds at scale."""

import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomgraph.operators.ordering import with_row_index

FOLDER = "/root/testdata/sf0.001"


def plan(spark, name):
    return entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "view_builds_on", "graph_v1_edges", "view_concepts", "view_paper_anchors", "paper_search", "candidate_ids",
    "ledger_upsert", "gate_verdicts", "lexicon_merge", "similarity_overlay", "page_window", "lineage_both", "similarity_top",
])
def test_no_nested_loops_and_no_row_udfs(spark, name):
    p = plan(spark, name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in p


@pytest.mark.parametrize("name", ["search_page", "vector_topk"])
def test_ranked_limits_cut_before_the_shuffle(spark, name):
    p = plan(spark, name)
    assert "Partial" in p and "WindowGroupLimit" in p


def test_top_k_is_not_a_sort(spark):
    assert "TakeOrderedAndProject" in plan(spark, "related_terms")


def test_scans_read_only_needed_columns(spark):
    schemas = [line.split("ReadSchema: ")[1] for line in plan(spark, "alias_resolve").splitlines()
               if "lineitem.parquet" in line]
    assert schemas and not any("l_extendedprice" in s or "l_shipdate" in s for s in schemas)


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(p_size), LessThanOrEqual(p_size,20)]" in plan(spark, "field_texts_of_graph")


GRAPH_QUERIES = [
    "graph_v1_nodes", "graph_v1_node_papers", "graph_v1_edges", "blocked_refs", "graph_v2_concepts", "graph_v2_edges",
    "graph_v2_counts", "view_concepts", "view_concept_papers", "view_builds_on", "view_nodes_by_type",
    "view_paper_defines", "view_paper_anchors", "graph_filter", "induced_subgraph", "graph_links",
]


@pytest.mark.parametrize("name", GRAPH_QUERIES)
def test_mentions_are_read_once(spark, name):
    """Names are resolved in one pass over the mentions, before the plan; few sorts remain."""
    p = plan(spark, name).split("Initial Plan")[0]
    assert "lineitem.parquet" not in p and p.count("SortAggregate(") <= 4


def test_jvm_only(spark):
    for name in ("graph_v2_concepts", "text_cut", "workflow_trace", "canon_names"):
        p = plan(spark, name)
        assert "Python" not in p and "Pandas" not in p and "Arrow" not in p


def test_resolved_mentions_are_columns(spark):
    """Readers of the resolved mentions take the columns they need, of a table whose size is known."""
    p = plan(spark, "view_concept_papers")
    assert "ExistingRDD" not in p and "FileScan parquet" in p


def test_numbered_rows_stay_where_they_are(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = with_row_index(spark.range(10), [F.col("id")], "i")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p
