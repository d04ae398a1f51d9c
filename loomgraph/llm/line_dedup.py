"""Cross-site line dedup: lines that occur on many distinct sites are boilerplate.

A HyperLogLog sketch of the sites is kept per line hash; sketches merge by aggregation, map
side first. Lines whose estimate is within `band` of the threshold get an exact distinct
count; the relative error of the sketch is 1.6 %, so a band of 0.2 is over ten deviations.
Lines above are boilerplate. Their places are sent to the documents, and the text is cut by
array functions.

Defined results: a line is a piece of the text between line feeds, compared without leading
and trailing ASCII white space; blank lines stay. A null site counts as one site of its own. Null
or empty text has no line to remove and comes out empty. Repeated rows are cut alike.
Columns other than id, text and site are not read."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomgraph.session import materialize

TRIM = "\t\n\x0b\x0c\r "


def _lines(rows: DataFrame) -> DataFrame:
    """row_ord, site, at, h1, h2 of every line that is not blank; two hashes are one 128-bit key."""
    line = F.trim("line", F.lit(TRIM))
    return (rows.select("row_ord", "site", F.posexplode(F.split("text", "\n")).alias("at", "line"))
            .withColumn("line", line).filter("line <> ''")
            .select("row_ord", "site", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")))


SALTS = 32


def boilerplate_lines(lines: DataFrame, min_sites: int = 10, band: float = 0.2, lg_k: int = 12) -> DataFrame:
    """h1, h2 of the lines on at least `min_sites` distinct sites."""
    spread = (lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"))
              .select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites"))
              .filter(F.col("sites") >= min_sites * (1 - band)))
    spread = materialize(spread)
    near = spread.filter(F.col("sites") < min_sites * (1 + band)).select("h1", "h2")
    places = lines.select("h1", "h2", "site").distinct()  # first, so that a hot line is a row per site
    exact = (places.join(near, ["h1", "h2"], "left_semi")
             .groupBy("h1", "h2").count().filter(F.col("count") >= min_sites).select("h1", "h2"))
    return materialize(spread.filter(F.col("sites") >= min_sites * (1 + band)).select("h1", "h2").unionByName(exact))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
               min_sites: int = 10, band: float = 0.2) -> DataFrame:
    """doc_id, text (lines that stay), n_lines, n_removed, one row per input row."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_ord"), F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.concat(F.lit("="), F.col(site_col).cast("string")), F.lit("")).alias("site"))
    lines = _lines(rows)
    spread = boilerplate_lines(lines, min_sites, band)
    # a line in a third of all documents is dealt over SALTS tasks by document
    salted = spread.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    cut = (lines.withColumn("salt", F.pmod(F.xxhash64("row_ord"), F.lit(SALTS)).cast("int"))
           .join(salted, ["h1", "h2", "salt"], "left_semi").groupBy("row_ord")
           .agg(F.collect_set("at").alias("gone")).withColumnRenamed("row_ord", "cut_ord"))
    pieces = F.split("text", "\n")
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.filter(pieces, lambda x, i: ~F.array_contains("gone", i)), "\n"))
    return rows.join(cut, F.col("row_ord") == F.col("cut_ord"), "left").select(
        "doc_id", kept.alias("text"),
        F.when(F.col("text") == "", 0).otherwise(F.size(pieces)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"))
