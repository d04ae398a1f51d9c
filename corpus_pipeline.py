"""A training corpus from raw documents, stage by stage. Each stage reads what its predecessor
wrote and passes whole rows on; the last returns the mix."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomgraph.llm.decontamination import clean_documents
from loomgraph.llm.exact_dedup import keep_one_of_each
from loomgraph.llm.language_id import identify, training_rows
from loomgraph.llm.mixing import mix_sources
from loomgraph.llm.ngram_join import keep_one_of_near
from loomgraph.llm.textops import fold, table
from loomgraph.session import ensure_checkpoint_dir


#: Rows of a document table in an Arrow batch: with whole rows on both sides of a task, the session's
#: default of 10,000 costs each task some hundred MB.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Stages are lazy, so the bound stays set for the session that runs them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    spark.conf.set(name, str(min(now, BATCH_ROWS) if now > 0 else BATCH_ROWS))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: no letter, or no language clearly ahead."""
    small_batches(spark)
    train = training_rows(docs, fold(F.col("doc_id"), 4) != 2)
    return identify(docs, train, carry=True).filter("not rejected").select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    small_batches(spark)
    return keep_one_of_each(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8."""
    small_batches(spark)
    return keep_one_of_near(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item go."""
    small_batches(spark)
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken."""
    small_batches(spark)
    return mix_sources(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

# Compression, near-duplicate groups and flow have no SQL form; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what stands between two stages is a table in the
    shared checkpoint folder."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
