"""Typed top-k retrieval of node vectors for a query vector, and what is built from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from loomgraph.functions.nodes import concept_line, paper_line
from loomgraph.functions.text import or_empty
from loomgraph.functions.vectors import score_against
from loomgraph.schemas import MAX_RELATED, SCORE_FLOOR, TOP_K


def split_by_type(vectors: DataFrame, node_type: str) -> DataFrame:
    """Vectors whose node id carries the type's prefix."""
    return vectors.filter(F.col("id").startswith(f"{node_type}:"))


def scored(vectors: DataFrame, query: list[float], floor: float = SCORE_FLOOR) -> DataFrame:
    """Adds `score` and keeps what reaches the floor; NaN (a zero vector) never does."""
    s = vectors.withColumn("score", score_against(query)("vec")).drop("vec")
    return s.filter(~F.isnan("score") & (F.col("score") >= floor))


def match(vectors: DataFrame, query: list[float], top: int = TOP_K,
          floor: float = SCORE_FLOOR) -> DataFrame:
    """The `top` nearest nodes at or above the floor; the smaller id wins a tie. Runs as a
    per-task top-k and a merge of those, never as a full sort."""
    return scored(vectors, query, floor).orderBy(F.desc("score"), "id").limit(top)


def match_each(vectors: DataFrame, query: list[float], by: str, top: int = TOP_K,
               floor: float = SCORE_FLOOR) -> DataFrame:
    """`match` for every value of a column at once. The rank filter lets Spark cut each
    task's rows to `top` per value before the shuffle, so a value that holds most rows
    still sends only `top` rows per task."""
    rank = F.row_number().over(W.partitionBy(by).orderBy(F.desc("score"), "id"))
    return scored(vectors, query, floor).withColumn("rank", rank).filter(F.col("rank") <= top)


def related_terms(concept_hits: DataFrame, paper_hits: DataFrame, concepts: DataFrame,
                  papers: DataFrame, limit: int = MAX_RELATED) -> DataFrame:
    """Names of matched concepts, then titles of matched papers, best first; hits without a
    node or a name are dropped. Hits are `match` results, hence few."""
    c = concept_hits.join(concepts.select("id", F.col("canonical").alias("term")), "id")
    p = paper_hits.join(papers.select("id", F.col("title").alias("term")), "id")
    both = c.select(F.lit(0).alias("side"), "score", "id", "term").unionByName(
        p.select(F.lit(1).alias("side"), "score", "id", "term")
    )
    return (
        both.filter(or_empty("term") != "")
        .orderBy("side", F.desc("score"), "id").limit(limit)
    )


def concept_lines(hits: DataFrame, concepts: DataFrame) -> DataFrame:
    """Report line per matched concept; a hit without a node shows its bare id."""
    j = hits.join(concepts.select("id", "canonical", "definition", "def_status"), "id", "left")
    name = F.coalesce("canonical", F.substring_index("id", ":", -1))
    return j.select("id", "score", concept_line(
        name, F.col("definition"), F.col("def_status"), F.col("score")).alias("line"))


def paper_lines(hits: DataFrame, papers: DataFrame) -> DataFrame:
    j = hits.join(papers.select("id", "title", "problem"), "id", "left")
    title = F.coalesce("title", F.substring_index("id", ":", -1))
    return j.select("id", "score", paper_line(title, F.col("problem"), F.col("score")).alias("line"))
