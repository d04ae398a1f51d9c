"""Paper files and search feeds."""

from __future__ import annotations

import time

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from loomgraph.external import Fetcher, PageDecoder
from loomgraph.schemas import DOWNLOAD_PAUSE_SECONDS, FEED, MIN_PDF_BYTES


def read_pdfs(spark: SparkSession, folder: str, minimum: int = MIN_PDF_BYTES) -> DataFrame:
    """paper_id, content of stored PDF files; files below the minimum size do not count."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
        .filter(F.col("length") >= minimum)
        .select(F.regexp_extract("path", r"([^/]+)\.pdf$", 1).alias("paper_id"), "content")
    )


def download_missing(papers: DataFrame, stored: DataFrame, fetcher: Fetcher,
                     minimum: int = MIN_PDF_BYTES, pause: float = DOWNLOAD_PAUSE_SECONDS) -> DataFrame:
    """paper_id, ok, message, content for papers not stored yet. Failures become rows. All
    downloads run in one task with a pause between them, as the remote service asks."""
    wanted = papers.select(F.col("pid").alias("paper_id")).join(
        stored.select("paper_id"), "paper_id", "left_anti"
    )

    def run(frames):
        waited = False
        for frame in frames:
            out = []
            for pid in frame["paper_id"]:
                if waited:
                    time.sleep(pause)
                waited = True
                try:
                    data = fetcher.fetch(pid)
                    ok = len(data) >= minimum
                    out.append((pid, ok, "downloaded" if ok else "too small", data if ok else None))
                except Exception as e:  # a failed download is a result, not a failed job
                    out.append((pid, False, str(e), None))
            yield pd.DataFrame(out, columns=["paper_id", "ok", "message", "content"])

    return wanted.coalesce(1).mapInPandas(run, "paper_id string, ok boolean, message string, content binary")


def decode_pages(pdfs: DataFrame, decoder: PageDecoder) -> DataFrame:
    """paper_id, page, text, error rows of binary files; a file that cannot be read is one row
    with the error."""

    def run(frames):
        for frame in frames:
            for pid, content in zip(frame["paper_id"], frame["content"]):
                try:
                    out = [(pid, i, t, None) for i, t in enumerate(decoder.pages(content))]
                except Exception as e:  # a broken file is a result, not a failed job
                    out = [(pid, None, None, str(e) or type(e).__name__)]
                yield pd.DataFrame(out, columns=["paper_id", "page", "text", "error"]).astype({"page": "Int32"})

    return pdfs.select("paper_id", "content").mapInPandas(run, "paper_id string, page int, text string, error string")


class PdfDecoder:
    """PDF text through pymupdf, where it is installed."""

    def pages(self, content: bytes):
        import pymupdf  # optional

        with pymupdf.open(stream=content, filetype="pdf") as doc:
            for page in doc:
                yield page.get_text()


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Staged search entries as JSON rows."""
    return spark.read.schema(FEED).json(path)


ATOM_ENTRY = (
    "id string, title string, summary string, published string, category array<struct<_term:string>>"
)


def read_atom(spark: SparkSession, folder: str, queries: DataFrame) -> DataFrame:
    """Staged Atom responses, one file per query. `queries` maps file_name to query_ord and
    query; entries of a file (one bounded service response) keep the service's order."""
    entries = (
        spark.read.format("xml").schema(ATOM_ENTRY).option("rowTag", "entry").load(folder)
        .select("*", "_metadata.file_name", "_metadata.file_block_start",
                F.monotonically_increasing_id().alias("seen"))
    )
    order = W.partitionBy("file_name").orderBy("file_block_start", "seen")
    return entries.withColumn("entry_ord", F.row_number().over(order) - 1).join(
        queries, "file_name"
    ).select(
        F.col("query_ord").cast("int"), "query", "entry_ord",
        "id", "title", "summary", "published",
        F.transform("category", lambda c: F.struct(c["_term"].alias("term"))).alias("tags"),
    )
