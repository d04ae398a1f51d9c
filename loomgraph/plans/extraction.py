"""From paper ids to stored records: download, pages, cut, content, lineage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from loomgraph.external import Extractor, Fetcher, PageDecoder, extract_contents, extract_lineage
from loomgraph.operators import mentions as M, papertext as P
from loomgraph.plans import incremental
from loomgraph.schemas import DOWNLOAD_PAUSE_SECONDS, MENTIONS, PAPERS
from loomgraph.session import materialize
from loomgraph.sources.papers import decode_pages, download_missing
from loomgraph.sources.records import read_contents, read_lineage
from loomgraph.sources.snapshots import Snapshots


def first_per_pid(records: DataFrame) -> DataFrame:
    """One record per paper; of several the smallest, so that every run chooses alike."""
    rest = [c for c in records.columns if c != "pid"]
    return records.groupBy("pid").agg(F.min(F.struct(*rest)).alias("r")).select("pid", "r.*")


def add_records(store: Snapshots, contents: DataFrame, lineage: DataFrame, force: bool = False) -> None:
    """Makes records part of the tables `papers` and `mentions` that a rebuild reads, both in one
    commit: a paper is never stored without its mentions. Papers stored already stay as they are,
    or are replaced when forced. Only buckets with new papers are written."""
    fresh = contents.select("pid").distinct()
    fresh = materialize(fresh if force else fresh.join(store.read("papers", PAPERS).select("pid"), "pid", "left_anti"))
    new = materialize(first_per_pid(contents.join(fresh, "pid", "left_semi")))
    rows = M.from_records(new, first_per_pid(lineage.join(fresh, "pid", "left_semi")))
    with store.commit() as c:
        c.replace("papers", fresh, M.papers_of(new), "pid", PAPERS)
        c.replace("mentions", fresh, rows, "pid", MENTIONS)
        if force:  # replaced records are no delta
            incremental.invalidate(c)


def import_records(store: Snapshots, folder: str, force: bool = False) -> None:
    """Adds the content and lineage records of a folder of JSON files."""
    add_records(store, read_contents(store.spark, folder), read_lineage(store.spark, folder), force)


@dataclass
class Extraction:
    """Runs the stages for a set of papers and adds their records to the store. A paper that
    fails a stage becomes a row with the reason; it never stops the others. Papers whose
    records are stored are skipped unless forced."""

    store: Snapshots
    fetcher: Fetcher
    decoder: PageDecoder
    extractor: Extractor
    stored_pdfs: DataFrame | None = None  # paper_id, content already on disk
    force: bool = False
    pause: float = DOWNLOAD_PAUSE_SECONDS  # between two downloads

    def run(self, wanted: DataFrame, run_id: str) -> DataFrame:
        """aid, ok, message for each wanted aid. Service results are written as soon as they
        exist, so no later stage repeats a call."""
        spark = wanted.sparkSession
        base = f"{self.store.root}/extractions/{run_id}"

        def keep(name: str, df: DataFrame) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{base}/{name}")
            return spark.read.parquet(f"{base}/{name}")

        known = self.store.read("papers", PAPERS).select("pid")
        pids = wanted.select(F.col("aid").alias("pid"))
        if not self.force:
            pids = pids.join(known, "pid", "left_anti")
        pids = keep("wanted", pids)
        none = spark.createDataFrame([], "paper_id string, content binary")
        stored = self.stored_pdfs if self.stored_pdfs is not None else none
        fetched = keep("downloads", download_missing(pids, stored, self.fetcher, pause=self.pause))
        have = stored.join(pids.withColumnRenamed("pid", "paper_id"), "paper_id", "left_semi")
        files = fetched.filter("ok").select("paper_id", "content").unionByName(have)
        pages = keep("pages", decode_pages(files, self.decoder))
        parsed = keep("parsed", P.parsed(P.full_texts(pages.filter("error is null"))))

        ready = parsed.filter("ok").select(F.col("paper_id").alias("pid"), "text")
        contents = keep("contents", extract_contents(ready, self.extractor))
        good = contents.filter("error is null").drop("error")
        lineage = keep("lineage", extract_lineage(good, ready, self.extractor))
        linked = lineage.filter("error is null").drop("error")
        add_records(self.store, good.join(linked.select("pid"), "pid", "left_semi"), linked, self.force)

        failures = (
            fetched.filter("not ok").select(F.col("paper_id").alias("aid"), F.concat(F.lit("download failed: "), "message").alias("failure"))
            .unionByName(pages.filter("error is not null").select(F.col("paper_id").alias("aid"), F.concat(F.lit("unreadable file: "), "error").alias("failure")))
            .unionByName(contents.unionByName(lineage, allowMissingColumns=True).filter("error is not null")
                         .select(F.col("pid").alias("aid"), F.concat(F.lit("extraction failed: "), "error").alias("failure")))
        )
        done = linked.select(F.col("pid").alias("aid"), F.lit(True).alias("done"))
        got = fetched.filter("ok").select(F.col("paper_id").alias("aid"), "message")
        skipped = wanted.select("aid").join(pids.withColumnRenamed("pid", "aid"), "aid", "left_anti").withColumn("skipped", F.lit(True))
        outcome = (wanted.select("aid").join(got, "aid", "left").join(done, "aid", "left")
                   .join(failures.groupBy("aid").agg(F.min("failure").alias("failure")), "aid", "left").join(skipped, "aid", "left"))
        ok = F.coalesce("done", "skipped", F.lit(False))
        return outcome.select(
            "aid", ok.alias("ok"),
            F.when(F.col("skipped"), F.lit("already stored"))
            .when(ok, F.concat(F.lit("extracted: "), F.coalesce("message", F.lit("stored file"))))
            .otherwise(F.coalesce("failure", F.lit("no text"))).alias("message"),
        )
