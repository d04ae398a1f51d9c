"""Mentions: one row per name a paper defines or builds on, and how they are registered.

A mention is (pid, phase, pos, name, definition); phase 0 defines, 1 builds on. `pos` may
be any orderable type. Every "first" below is a min over (pid, phase, pos), an aggregate
that combines map-side, so a name in a third of all rows never lands whole in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.functions.text import canon, or_empty
from loomgraph.operators.lexicon import alias_map, representatives
from loomgraph.schemas import BUILDS_ON, DEFINES
from loomgraph.session import stored


def from_records(contents: DataFrame, lineage: DataFrame) -> DataFrame:
    """Explodes content records (defines) and lineage records (builds_on)."""
    defines = contents.select(
        "pid", F.lit(DEFINES).alias("phase"), F.posexplode("defines").alias("pos", "d")
    ).select("pid", "phase", "pos", F.col("d.name").alias("name"),
             or_empty("d.definition").alias("definition"))
    builds = lineage.select(
        "pid", F.lit(BUILDS_ON).alias("phase"), F.posexplode("builds_on").alias("pos", "name")
    ).withColumn("definition", F.lit(""))
    return defines.unionByName(builds)


def papers_of(contents: DataFrame) -> DataFrame:
    """Paper rows of content records, with the number of names each defines."""
    return contents.select(
        "pid", "title", "problem", "task", "domain", "paper_type",
        F.coalesce(F.size("defines"), F.lit(0)).alias("n_defines"),
    )


def strays(mentions: DataFrame, papers: DataFrame) -> DataFrame:
    """pid: papers that are mentioned without a record of their own. They are few, so dropping or marking
    their mentions moves none of the others, where a join with all papers would deal out every mention."""
    return stored(mentions.select("pid").distinct().join(papers.select("pid"), "pid", "left_anti"))


def of_records(mentions: DataFrame, papers: DataFrame) -> DataFrame:
    """Mentions of papers that have a record."""
    return mentions.filter("pid is not null").join(strays(mentions, papers), "pid", "left_anti")


def keyed(mentions: DataFrame) -> DataFrame:
    return mentions.withColumn("key", canon("name"))


@dataclass
class Resolved:
    """Mentions resolved once, as a written table that every output of a graph reads."""

    rows: DataFrame        # pid, phase, pos, name, definition (null when blank), rk
    names: DataFrame       # rk, label, status, lex_definition: one row per name that occurs or is known
    registered: DataFrame  # new lexicon rows, with `at`


def resolve_mentions(mentions: DataFrame, lexicon: DataFrame, register) -> Resolved:
    """Reads the mentions and builds their keys in one pass; what the lexicon says about a
    name stays in `names` and is joined once per name, after aggregation, never carried by mentions.
    `register` is one of the two registrations below."""
    keyed_rows = keyed(mentions).join(alias_map(lexicon).withColumnRenamed("rk", "known"), "key", "left")
    rows = stored(keyed_rows.select(
        "pid", "phase", "pos", "name", F.nullif("definition", F.lit("")).alias("definition"),
        F.coalesce("known", "key").alias("rk"), F.col("known").isNull().alias("unknown"),
    ))
    registered = stored(register(rows.filter("unknown").withColumnRenamed("rk", "key")))
    names = stored(representatives(lexicon).unionByName(registered.select(
        "rk", "label", "status", F.col("definition").alias("lex_definition"))))
    return Resolved(rows.drop("unknown"), names, registered)


def unknown(keyed_mentions: DataFrame, lookup: DataFrame) -> DataFrame:
    """Mentions whose key the lexicon does not resolve. Dropping the known ones before any
    aggregation leaves the new names only; a lexicon of ordinary size is broadcast."""
    return keyed_mentions.join(lookup.select("key"), "key", "left_anti")


def _registrations(firsts: DataFrame, definition: Column) -> DataFrame:
    """New lexicon rows from the deciding mention `e` of each unknown key."""
    defined = F.col("e.phase") == DEFINES
    return firsts.select(
        F.col("key").alias("rk"),
        F.col("e.name").alias("label"),
        F.when(defined, "unreviewed").otherwise("pending").alias("status"),
        definition.alias("definition"),
        F.when(defined, "defines").otherwise("builds_on").alias("source"),
        F.col("e.pid").alias("first_seen"),
        F.col("e").alias("at"),
    )


def register_defines_first(unknown_mentions: DataFrame) -> DataFrame:
    """New names when all defines are seen before any build: a name that anyone defines is
    unreviewed and keeps its first definition; a name only built on is pending."""
    text = F.when(F.col("phase") == DEFINES, or_empty("definition")).otherwise(F.lit(""))
    event = F.struct("phase", "pid", "pos", "name", text.alias("definition"))
    firsts = unknown_mentions.groupBy("key").agg(F.min(event).alias("e"))
    return _registrations(firsts, F.col("e.definition"))


def register_in_order(unknown_mentions: DataFrame) -> DataFrame:
    """New names when each paper's defines and builds are seen together, paper by paper:
    the very first mention decides, and no definition is kept."""
    event = F.struct("pid", "phase", "pos", "name")
    firsts = unknown_mentions.groupBy("key").agg(F.min(event).alias("e"))
    return _registrations(firsts, F.lit(""))


def registration_counts(new: DataFrame) -> DataFrame:
    """New names by status."""
    return new.groupBy("status").agg(F.count("*").alias("n"))
