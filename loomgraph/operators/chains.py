"""Where chains of merges end, and in which order their members come: pointer doubling.

A merge (src, dst, seq) makes src a child of dst; what is never merged away is a root. Both answers
take a number of rounds that grows with the logarithm of the longest chain: in a round every pointer
jumps over the one it points to.

Order is that of a walk from the root which visits children by (seq, name). Children are numbered by one
range-partitioned sort, so a target of a third of all merges is no group. Only children that have
children of their own are stations of the walk, one on the way in and one on the way out; the others
are counted between stations. Ranking the list of stations by doubling gives every member its place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.operators.ordering import with_row_index, with_running_sums
from loomgraph.session import materialize


SHORT_ROUNDS = 5


class Circle(ValueError):
    """Merges that lead back to where they start."""


def chain_ends(step: DataFrame) -> DataFrame:
    """src, root for each row of `step` (src once, dst, seq), which must be materialized."""
    ends = step.select("src", F.col("dst").alias("root"))
    rounds = step.count().bit_length() + 1
    for _ in range(rounds):
        up = ends.select(F.col("src").alias("via"), F.col("root").alias("up"))
        met = materialize(ends.join(up, F.col("root") == F.col("via"), "left").select(
            "src", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")))
        ends = met.select("src", "root")
        if met.filter("moved").isEmpty():
            return ends
    raise Circle  # no chain is longer than there are merges


def short_chains(step: DataFrame) -> DataFrame | None:
    """src, root, path (seq and name from below the root down) where no chain is longer than
    2 ** (SHORT_ROUNDS - 1) merges, else None. Paths are joined by the same doubling."""
    ends = step.select("src", F.col("dst").alias("root"), F.array(F.struct("seq", F.col("src").alias("name"))).alias("path"))
    for _ in range(SHORT_ROUNDS):
        up = ends.select(F.col("src").alias("via"), F.col("root").alias("up"), F.col("path").alias("above"))
        met = materialize(ends.join(up, F.col("root") == F.col("via"), "left").select(
            "src", F.coalesce("up", "root").alias("root"), F.when(F.col("up").isNull(), F.col("path")).otherwise(F.concat("above", "path")).alias("path"),
            F.col("up").isNotNull().alias("moved")))
        ends = met.select("src", "root", "path")
        if met.filter("moved").isEmpty():
            return ends
    return None


def ends_and_places(step: DataFrame) -> DataFrame:
    """src, root, place. Short chains are sorted by their paths, which costs one sort; longer ones are ranked."""
    short = short_chains(step)
    if short is None:
        return chain_ends(step).join(walk_places(step), "src")
    placed = with_row_index(short, [F.col("root"), F.col("path")], "i").select("src", "root", "i")
    first = placed.groupBy(F.col("root").alias("of")).agg(F.min("i").alias("lo"))
    return placed.join(first, F.col("root") == F.col("of")).select("src", "root", (F.col("i") - F.col("lo")).alias("place"))


def ranked(stations: DataFrame) -> DataFrame:
    """id, total for each station (id, before, weight): its weight and those of all stations before it."""
    now = stations.select("id", "before", F.col("weight").alias("total"))
    while not now.filter("before is not null").isEmpty():
        back = now.select(F.col("id").alias("at"), F.col("before").alias("next"), F.col("total").alias("more"))
        now = materialize(now.join(back, F.col("before") == F.col("at"), "left").select(
            "id", F.col("next").alias("before"), (F.col("total") + F.coalesce("more", F.lit(0))).alias("total")))
    return now.select("id", "total")


def walk_places(step: DataFrame) -> DataFrame:
    """src, place: how many members of its tree come before it in the walk."""
    parents = step.select(F.col("dst").alias("p")).distinct()
    marked = step.join(parents, F.col("src") == F.col("p"), "left").select("src", "dst", "seq", F.col("p").isNotNull().cast("bigint").alias("inner"))
    # i: position among all; c: stations up to and with it, which numbers the stations
    order = [F.col("dst"), F.col("seq"), F.col("src")]
    rows = materialize(with_running_sums(marked, order, {"i": F.lit(1).cast("bigint"), "c": F.col("inner")}))
    kids = rows.groupBy(F.col("dst").alias("of")).agg(
        F.min("i").alias("lo"), F.count("*").alias("kids"), F.max(F.when(F.col("inner") == 1, F.struct("c", "i"))).alias("last"))
    placed = materialize(rows.join(kids.select("of", "lo"), F.col("dst") == F.col("of")).select(
        "src", "dst", "c", (F.col("i") - F.col("lo")).alias("pos"), "inner"))
    inner = placed.filter("inner = 1")
    parent = inner.select(F.col("src").alias("above"), F.col("c").alias("above_c"))
    if inner.isEmpty():
        return placed.select("src", F.col("pos").alias("place"))

    def sibling(number: Column, rows: DataFrame) -> DataFrame:
        """Joins the station of that number where it has the same target."""
        other = inner.select(F.col("c").alias("other_c"), F.col("dst").alias("other_dst"), F.col("pos").alias("other_pos"))
        return rows.join(other, (number == F.col("other_c")) & (F.col("dst") == F.col("other_dst")), "left")

    into = sibling(F.col("c") - 1, inner).join(parent, F.col("dst") == F.col("above"), "left").select(
        way_in("c").alias("id"), F.coalesce(way_out("other_c"), way_in("above_c")).alias("before"),
        (F.col("pos") - F.coalesce("other_pos", F.lit(-1))).alias("weight"))
    out = inner.join(kids, F.col("src") == F.col("of")).select(
        way_out("c").alias("id"), F.coalesce(way_out("last.c"), way_in("c")).alias("before"),
        (F.col("kids") - 1 - F.coalesce(F.col("last.i") - F.col("lo"), F.lit(-1))).alias("weight"))
    totals = ranked(materialize(into.unionByName(out)))
    stations = inner.select("src", way_in("c").alias("id")).join(totals, "id").select("src", (F.col("total") - 1).alias("place"))
    plain = sibling(F.col("c"), placed.filter("inner = 0")).join(parent, F.col("dst") == F.col("above"), "left").select(
        "src", F.coalesce(way_out("other_c"), way_in("above_c")).alias("id"), (F.col("pos") - F.coalesce("other_pos", F.lit(0))).alias("past"),
        F.col("other_c").isNotNull().cast("bigint").alias("behind"))
    others = plain.join(totals, "id", "left").select("src", (F.coalesce("total", F.lit(0)) + F.col("past") - F.col("behind")).alias("place"))
    return stations.unionByName(others)


def way_in(number: str) -> Column:
    return 2 * F.col(number)


def way_out(number: str) -> Column:
    return 2 * F.col(number) + 1
