"""Ancestor / descendant closure over concept lineage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from loomgraph.functions.text import canon
from loomgraph.session import Scratch

MERGE_LEVELS = 16


@dataclass
class Lineage:
    key: str
    ids: DataFrame      # id: the selected nodes, the start included
    ancestors: int
    descendants: int


def find_node(nodes: DataFrame, name: str, strict_lower: bool = False) -> str | None:
    """Key of the node a user names. `strict_lower` only lower-cases, so labels with
    hyphens are then not found."""
    key = F.lower(F.lit(name)) if strict_lower else canon(F.lit(name))
    hit = nodes.filter(F.col("id") == key).select("id").first()
    return hit["id"] if hit else None


def closure(edges: DataFrame, start: DataFrame, direction: str = "both") -> DataFrame:
    """side, id rows reachable from `start` (one column id): ancestors follow src -> dst,
    descendants dst -> src; the start itself is left out.

    Breadth-first, both sides in one walk: each level joins the frontier with the edges and
    drops what was seen. Edges are written once, dealt by (side, id); each frontier is a small
    written table, so plans stay short, a lost executor costs one level, and adaptive
    execution knows its size and broadcasts it or splits a hot node's edges. Every MERGE_LEVELS
    levels what was seen becomes one table and the frontiers before are removed.
    """
    scratch = Scratch(edges.sparkSession)
    up = edges.select(F.lit("ancestor").alias("side"), F.col("src").alias("id"), F.col("dst").alias("next"))
    down = edges.select(F.lit("descendant").alias("side"), F.col("dst").alias("id"), F.col("src").alias("next"))
    steps = {"ancestors": up, "descendants": down}.get(direction, up.unionByName(down))
    steps = scratch.write("edges", steps.repartition("side", "id").sortWithinPartitions("side", "id"))
    sides = {"ancestors": ["ancestor"], "descendants": ["descendant"]}.get(direction, ["ancestor", "descendant"])

    origin = start.select(F.explode(F.array(*[F.lit(s) for s in sides])).alias("side"), "id").distinct()
    frontier = visited = scratch.write("level-0", origin)
    names, level = ["level-0"], 0
    while not frontier.isEmpty():
        level += 1
        reached = steps.join(frontier, ["side", "id"], "left_semi").select("side", F.col("next").alias("id")).distinct()
        frontier = scratch.write(f"level-{level}", reached.join(visited, ["side", "id"], "left_anti"))
        visited = visited.unionByName(frontier)
        names.append(f"level-{level}")
        if level % MERGE_LEVELS == 0:
            visited = scratch.write(f"seen-{level}", visited)
            for old in names[:-1]:  # the frontier is still read
                scratch.remove(old)
            names = [f"seen-{level}", names[-1]]
    scratch.remove("edges")
    return visited.join(start.select("id"), "id", "left_anti").select("side", "id")


def side_counts(reached: DataFrame) -> DataFrame:
    """ancestors, descendants: how many rows of a closure each side has."""
    return reached.agg(F.count_if(F.col("side") == "ancestor").alias("ancestors"), F.count_if(F.col("side") == "descendant").alias("descendants"))


def lineage(edges: DataFrame, nodes: DataFrame, name: str, direction: str = "both",
            strict_lower: bool = False) -> Lineage | None:
    """Selection around one node; None when it does not exist. `both` is the union of the
    two closures (not the connected component); an unknown direction means both. The counts
    always cover both sides."""
    key = find_node(nodes, name, strict_lower)
    if key is None:
        return None
    start = nodes.sparkSession.range(1).select(F.lit(key).alias("id"))
    reached = closure(edges.select("src", "dst"), start)
    wanted = {"ancestors": ["ancestor"], "descendants": ["descendant"]}.get(direction, ["ancestor", "descendant"])
    ids = reached.filter(F.col("side").isin(wanted)).select("id").unionByName(start).distinct()
    n = side_counts(reached).first()
    return Lineage(key, ids, n[0], n[1])
