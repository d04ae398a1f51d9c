"""Paper collection: search results, ledger, candidate funnel, gate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loomgraph.external import Classifier
from loomgraph.functions.text import (
    iso_day, normalize_paper_id, or_empty, squeeze, strip, tag_terms, year_month,
)
from loomgraph.schemas import GATE, MAX_RESULTS_PER_QUERY, PASS_VERDICT, REJECT_VERDICTS


def dedup_queries(queries: DataFrame) -> DataFrame:
    """(ord, query) -> first spelling per case-insensitive trimmed query; blanks dropped."""
    q = queries.select("ord", strip(or_empty("query")).alias("query")).filter("query <> ''")
    return (
        q.groupBy(F.lower("query").alias("folded"))
        .agg(F.min(F.struct("ord", "query")).alias("f"))
        .select("f.ord", "f.query")
    )


def in_period(month: Column, period_from: str = "", period_to: str = "") -> Column:
    """Inclusive YYYY-MM bounds, compared as text; an empty month passes both."""
    ok = F.lit(True)
    if period_from:
        ok = ok & (month >= period_from)
    if period_to:
        ok = ok & (month <= period_to)
    return (month == "") | ok


def newest_per_query(feed: DataFrame, limit: int | None = MAX_RESULTS_PER_QUERY) -> DataFrame:
    """Adds `rank`, newest first per query. `limit` is the page size of the search service,
    for a service that returns everything; Spark trims each task to it before the shuffle."""
    rank = F.row_number().over(
        W.partitionBy("query_ord").orderBy(F.desc("published"), "entry_ord")
    )
    ranked = feed.withColumn("rank", rank)
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def search_results(feed: DataFrame, period_from: str = "", period_to: str = "",
                   limit: int | None = None) -> DataFrame:
    """One row per paper id over all queries; the first query that found it keeps it. The
    feed is what the service returned, so no limit applies by default; one that is given
    comes before the period filter and the deduplication."""
    return first_per_id(newest_per_query(feed, limit), period_from, period_to)


def first_per_id(entries: DataFrame, period_from: str = "", period_to: str = "") -> DataFrame:
    """Normalized, period-filtered entries (with `rank`), one per id."""
    rows = entries.select(
        normalize_paper_id("id").alias("aid"),
        "query_ord", "rank",
        squeeze("title").alias("title"),
        squeeze("summary").alias("abstract"),
        iso_day("published").alias("published"),
        tag_terms("tags").alias("categories"),
        F.col("query").alias("first_seen_query"),
    ).filter((F.col("aid") != "") & in_period(year_month("published"), period_from, period_to))
    payload = ["title", "abstract", "published", "categories", "first_seen_query"]
    return (
        rows.groupBy("aid")
        .agg(F.min(F.struct("query_ord", "rank", *payload)).alias("f"))
        .select("aid", *[F.col(f"f.{c}").alias(c) for c in ("query_ord", "rank", *payload)])
    )


# --- ledger ---------------------------------------------------------------------------


def upsert_ledger(ledger: DataFrame, found: DataFrame) -> DataFrame:
    """Known papers get fresh metadata and keep gate, extracted and first query; new ones
    start without a verdict."""
    new = found.select("aid", *[
        F.col(c).alias(f"f_{c}")
        for c in ("title", "abstract", "published", "categories", "first_seen_query")
    ], F.lit(True).alias("hit"))
    old = ledger.withColumn("known", F.lit(True))
    j = old.join(new, "aid", "full_outer")

    def fresh(c):
        return F.when(F.col("hit"), F.col(f"f_{c}")).otherwise(F.col(c)).alias(c)

    return j.select(
        "aid", *[fresh(c) for c in ("title", "abstract", "published", "categories")],
        "gate",
        F.coalesce("extracted", F.lit(False)).alias("extracted"),
        F.when(F.col("known"), F.col("first_seen_query"))
        .otherwise(F.col("f_first_seen_query")).alias("first_seen_query"),
    )


def mark_extracted(ledger: DataFrame, done: DataFrame) -> DataFrame:
    hit = done.select("aid", F.lit(True).alias("done")).distinct()
    return ledger.join(hit, "aid", "left").withColumn(
        "extracted", F.coalesce("done", "extracted")
    ).drop("done")


def owned_ids(papers: DataFrame) -> DataFrame:
    return papers.select(F.col("pid").alias("aid"))


def judged(found: DataFrame, owned: DataFrame, ledger: DataFrame,
           reject: tuple[str, ...] = REJECT_VERDICTS) -> DataFrame:
    """Adds `fate`: owned, gate or new. Ownership is tested first."""
    have = owned.select("aid", F.lit(True).alias("owned")).distinct()
    verdict = ledger.select("aid", F.lower(or_empty("gate.verdict")).alias("verdict"))
    j = found.join(have, "aid", "left").join(verdict, "aid", "left")
    fate = (
        F.when(F.col("owned"), "owned")
        .when(F.coalesce(F.col("verdict").isin(*reject), F.lit(False)), "gate")
        .otherwise("new")
    )
    return j.withColumn("fate", fate).drop("owned", "verdict")


def new_candidates(judged_rows: DataFrame) -> DataFrame:
    return judged_rows.filter("fate = 'new'").drop("fate")


def funnel(judged_rows: DataFrame) -> DataFrame:
    return judged_rows.agg(
        F.count("*").alias("found"),
        F.count_if(F.col("fate") == "owned").alias("owned_excluded"),
        F.count_if(F.col("fate") == "gate").alias("gate_excluded"),
        F.count_if(F.col("fate") == "new").alias("new"),
    )


def completeness(found: DataFrame) -> DataFrame:
    """Rows whose title, abstract and date are all present; `majority` when at least half."""
    full = (or_empty("title") != "") & (or_empty("abstract") != "") & (or_empty("published") != "")
    return found.agg(F.count("*").alias("n"), F.count_if(full).alias("complete")).withColumn(
        "majority", F.col("complete") * 2 >= F.col("n")
    )


# --- gate -------------------------------------------------------------------------------


@dataclass
class GateOutcome:
    verdicts: DataFrame  # aid, gate, cached
    results: DataFrame   # aid, verdict, passed, cached
    ledger: DataFrame    # with the new verdicts


def gate_results(verdicts: DataFrame) -> DataFrame:
    return verdicts.select(
        "aid", "gate.verdict", (F.col("gate.verdict") == PASS_VERDICT).alias("passed"), "cached"
    )


def store_verdicts(ledger: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The ledger with freshly judged verdicts; cached ones are there already."""
    fresh = verdicts.filter("not cached").select("aid", F.col("gate").alias("new_gate"))
    return ledger.join(fresh, "aid", "left").withColumn(
        "gate", F.coalesce("new_gate", "gate")
    ).select(*ledger.columns)


def run_gate(ledger: DataFrame, candidates: DataFrame, classifier: Classifier,
             prompt_ver: str, date: str) -> GateOutcome:
    """Judges candidates; a verdict stored under the same prompt version is reused and its
    paper is never sent to the classifier."""
    asked = ledger.join(candidates.select("aid").distinct(), "aid", "left_semi")
    hit = F.coalesce(F.col("gate.prompt_ver") == prompt_ver, F.lit(False))
    cached = asked.filter(hit).select("aid", "gate", F.lit(True).alias("cached"))
    fresh = classifier.classify(asked.filter(~hit).select("aid", "title", "abstract")).select(
        "aid",
        F.struct(
            "verdict", or_empty("reason").alias("reason"),
            F.lit(classifier.model).alias("model"),
            F.lit(prompt_ver).alias("prompt_ver"), F.lit(date).alias("date"),
        ).cast(GATE).alias("gate"),
        F.lit(False).alias("cached"),
    )
    verdicts = cached.unionByName(fresh)
    return GateOutcome(verdicts, gate_results(verdicts), store_verdicts(ledger, verdicts))


def gate_funnel(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count("*").alias("judged"),
        F.count_if("passed").alias("passed"),
        F.count_if(~F.col("cached")).alias("calls"),
        F.count_if("cached").alias("cache_hits"),
    )
