"""Paper text: leading pages up to a character budget, joined and cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from loomgraph.functions.text import find_cut
from loomgraph.schemas import HEAD_CHARS, PAGE_BUDGET_CHARS
from loomgraph.session import materialize

PAGES_PER_BUCKET = 1024


def page_cutoffs(pages: DataFrame, budget: int = PAGE_BUDGET_CHARS) -> DataFrame:
    """paper_id, last_page: the page on which the running length first reaches the budget;
    papers that never reach it have no row.

    The running sum is taken over buckets of pages first (lengths add up map-side) and over
    single pages only inside the bucket that crosses, so a paper with an extreme number of
    pages is never one window partition of single pages. The lengths are checkpointed: they
    are needed twice, and the texts behind them should be read once.
    """
    lens = materialize(pages.select(
        "paper_id", "page", F.length("text").alias("len"),
        F.floor(F.col("page") / PAGES_PER_BUCKET).alias("bucket"),
    ))
    sums = lens.groupBy("paper_id", "bucket").agg(F.sum("len").alias("len"))
    up_to = W.partitionBy("paper_id").orderBy("bucket")
    crossing = (
        sums.withColumn("upto", F.sum("len").over(up_to))
        .filter((F.col("upto") >= budget) & (F.col("upto") - F.col("len") < budget))
        .select("paper_id", "bucket", (F.col("upto") - F.col("len")).alias("before"))
    )
    inside = W.partitionBy("paper_id", "bucket").orderBy("page")
    return (
        lens.join(crossing, ["paper_id", "bucket"])
        .withColumn("upto", F.col("before") + F.sum("len").over(inside))
        .filter(F.col("upto") >= budget)
        .groupBy("paper_id").agg(F.min("page").alias("last_page"))
    )


def leading_pages(pages: DataFrame, budget: int | None = PAGE_BUDGET_CHARS) -> DataFrame:
    """Pages up to and including the one that crosses the budget; all pages without one."""
    if budget is None:
        return pages
    return (
        pages.join(page_cutoffs(pages, budget), "paper_id", "left")
        .filter("last_page is null or page <= last_page")
        .drop("last_page")
    )


def full_texts(pages: DataFrame, budget: int | None = PAGE_BUDGET_CHARS) -> DataFrame:
    """paper_id, full: the leading pages joined in order. What is gathered per paper is
    bounded by the budget plus one page, or is the paper's text; empty pages add nothing and are left out."""
    kept = leading_pages(pages, budget)
    listed = F.sort_array(F.collect_list(F.when(F.length("text") > 0, F.struct("page", "text"))))
    return kept.groupBy("paper_id").agg(
        F.array_join(F.transform(listed, lambda p: p["text"]), "").alias("full")
    )


def parsed(texts: DataFrame, column: str = "full", head: int | None = HEAD_CHARS) -> DataFrame:
    """paper_id, ok, reason, cut_method, char_count, text from whole texts; a null text is
    a paper whose file is missing."""
    have = F.col(column).isNotNull()
    cut = texts.withColumn("cut", find_cut(column, head))
    return cut.select(
        "paper_id",
        have.alias("ok"),
        F.when(~have, "PDF missing").alias("reason"),
        F.when(have, F.col("cut.cut_method")).alias("cut_method"),
        F.when(have, F.length("cut.text").cast("bigint")).alias("char_count"),
        F.when(have, F.col("cut.text")).otherwise(F.lit("")).alias("text"),
    )
