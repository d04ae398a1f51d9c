"""JSON record files: one document per paper, the paper id in the file name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomgraph.schemas import CONTENT, LEXICON_FILE, LEXICON_FILE_LEGACY, LINEAGE, PARSED


def paper_registry(spark: SparkSession, maps: dict[str, list[str]]) -> DataFrame:
    """pid, map_name rows of the configured paper lists."""
    rows = [(pid, name) for name, ids in maps.items() for pid in ids]
    return spark.createDataFrame(rows, "pid string, map_name string")


def _records(spark: SparkSession, folder: str, kind: str, schema: str) -> DataFrame:
    name = F.col("_metadata.file_name")
    return (
        spark.read.schema(schema).option("multiLine", True)
        .option("pathGlobFilter", f"*.{kind}.json").json(folder)
        .select(F.regexp_replace(name, rf"\.{kind}\.json$", "").alias("pid"), "*")
    )


def read_contents(spark: SparkSession, folder: str) -> DataFrame:
    return _records(spark, folder, "concepts", CONTENT)


def read_lineage(spark: SparkSession, folder: str) -> DataFrame:
    return _records(spark, folder, "relations", LINEAGE)


def read_parsed(spark: SparkSession, folder: str) -> DataFrame:
    return _records(spark, folder, "parsed", PARSED).drop("paper_id")


def dry_run(papers: DataFrame, n: int = 2) -> DataFrame:
    """The first papers in id order, for trying a service before a full run."""
    return papers.orderBy("pid").limit(n)


def texts_of(papers: DataFrame, parsed: DataFrame) -> DataFrame:
    """pid -> parsed text."""
    return papers.select("pid").join(parsed.select("pid", "text"), "pid")


def read_lexicon_json(spark: SparkSession, path: str) -> DataFrame:
    """Ordered lexicon rows from a lexicon document (current form, or the older one that
    maps a name to its aliases only)."""
    wide = spark.read.schema(LEXICON_FILE).option("multiLine", True).json(path)
    rows = wide.select(F.posexplode(F.map_entries("techniques")).alias("ord", "e")).select(
        F.col("ord").cast("bigint").alias("ord"), F.col("e.key").alias("name"), "e.value.*"
    )
    return rows


def read_legacy_lexicon_json(spark: SparkSession, path: str) -> DataFrame:
    wide = spark.read.schema(LEXICON_FILE_LEGACY).option("multiLine", True).json(path)
    empty = F.lit("")
    return wide.select(F.posexplode(F.map_entries("techniques")).alias("ord", "e")).select(
        F.col("ord").cast("bigint").alias("ord"), F.col("e.key").alias("name"),
        F.col("e.value").alias("aliases"), F.lit("unreviewed").alias("status"),
        empty.alias("definition"), empty.alias("source"), empty.alias("first_seen"),
    )
