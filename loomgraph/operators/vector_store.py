"""Vector store: rows (model, id, vec), grown incrementally."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomgraph.external import Embedder, embed_texts
from loomgraph.functions.nodes import node_text, typed_embed_text
from loomgraph.functions.text import is_blank
from loomgraph.operators.ordering import with_row_index
from loomgraph.schemas import EMBED_BATCH


def v1_texts(nodes: DataFrame) -> DataFrame:
    """id, text of single-type nodes; a node without definition falls back to its name."""
    return nodes.select(
        F.col("key").alias("id"),
        node_text(F.col("canonical"), F.col("definition"), F.col("ptype")).alias("text"),
    )


def v2_texts(concepts: DataFrame, papers: DataFrame) -> DataFrame:
    """id, text of typed nodes; null where there is nothing to embed."""
    c = concepts.select(
        F.concat(F.lit("concept:"), "rk").alias("id"),
        typed_embed_text(F.lit("concept"), F.col("definition"), F.lit("")).alias("text"),
    )
    p = papers.select(
        F.concat(F.lit("paper:"), "pid").alias("id"),
        typed_embed_text(F.lit("paper"), F.lit(""), F.col("problem")).alias("text"),
    )
    return c.unionByName(p)


def todo(texts: DataFrame, store: DataFrame, model: str, force: bool = False) -> DataFrame:
    """Texts still without a vector of this model. Keyed by id only: an edited text keeps
    its old vector until forced."""
    wanted = texts.filter("text is not null")
    if force:
        return wanted
    have = store.filter(F.col("model") == model).select("id")
    return wanted.join(have, "id", "left_anti")


def batch_numbers(items: DataFrame, batch: int = EMBED_BATCH) -> DataFrame:
    """Service batch of every item, in id order."""
    return with_row_index(items, [F.col("id")], "i").withColumn(
        "batch_no", F.floor(F.col("i") / batch)
    ).drop("i")


def refresh(texts: DataFrame, store: DataFrame, embedder: Embedder, force: bool = False) -> DataFrame:
    """The store after embedding what is missing; vectors of another model are dropped."""
    new = embed_texts(todo(texts, store, embedder.model, force), embedder).withColumn(
        "model", F.lit(embedder.model)
    ).select("model", "id", "vec")
    if force:
        return new
    return store.filter(F.col("model") == embedder.model).select("model", "id", "vec").unionByName(new)


def summary(store: DataFrame) -> DataFrame:
    """Vectors per model and node type, with their dimension."""
    return store.groupBy("model", F.substring_index("id", ":", 1).alias("type")).agg(
        F.count("*").alias("n"), F.max(F.size("vec")).alias("dim")
    )


def skipped_count(texts: DataFrame) -> DataFrame:
    """How many typed nodes have nothing to embed."""
    return texts.agg(F.count_if(F.col("text").isNull()).alias("skipped"))


def fallback_count(nodes: DataFrame) -> DataFrame:
    """How many nodes have no definition of their own to embed."""
    return nodes.agg(F.count_if(is_blank("definition")).alias("without_definition"))
