"""Connected components of a link table by alternating large and small stars, each round a few joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.session import checkpointed, packed


def _star(edges: DataFrame, tasks: int) -> DataFrame:
    """Link the larger neighbours of every node to the least of it and its neighbours; links may repeat."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(tasks)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    up = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return up.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every node and its smaller neighbours to the least of them; links may repeat."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node links to one centre only, and no centre links on to a lesser node."""
    rows, nodes, upward = edges.agg(F.count("*"), F.count_distinct("a"), F.count_if(F.col("a") < F.col("b"))).first()
    return rows == nodes and not upward and edges.join(edges.select(F.col("b").alias("a")), "a", "left_semi").isEmpty()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its least node.

    Self-links and nulls are ignored, so a node without another link is absent; repeated links change nothing; an empty
    table gives an empty one. Every round is checkpointed in the shared folder; rounds grow with the logarithm of the
    size of a component. A partition holds 100,000 links at most where shuffle partitions allow it, so that few links take
    few tasks; no more of a component is ever held in one place. No round adds links.
    """
    edges = packed(checkpointed(links.select("a", "b").where("a <> b").distinct()))
    tasks = edges.rdd.getNumPartitions()
    while not _are_stars(edges):
        larger = checkpointed(_star(edges, tasks).coalesce(tasks).distinct()).coalesce(tasks)  # read three times
        edges = checkpointed(_small_star(larger).coalesce(tasks).distinct()).coalesce(tasks)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
