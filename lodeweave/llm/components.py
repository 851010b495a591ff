"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

MOST_TURNS = 60


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars whose middles are their smallest nodes: no node has two parents, or a parent and children."""
    up, down = F.lit(1).alias("up"), F.lit(0).alias("down")
    ends = edges.select(F.col("a").alias("node"), up, down).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.filter("up + down > 1").isEmpty()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. edges (a, b) with a > b; both ends of each see it in a large star, the larger in a small one."""
    seen = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = seen.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    # The hub of a star has many rows here: a plain inner sort-merge join, which Spark splits where it is skewed.
    # A large star moves only the larger neighbours, so only these are joined.
    moved = seen.filter("b > a") if large else seen
    joined = moved.hint("merge").join(least.hint("merge"), "a")
    if large:
        linked = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        linked = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return linked.filter("a <> b").distinct()


def components(edges: DataFrame, space: Workspace, name: str = "components") -> DataFrame:
    """(node, component) of every node that has an edge, as the table `name`; the component is its smallest node.

    edges (a, b): longs in any order; loops and repeats don't matter.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    held = f"{name}-0"
    edges = space.stage(edges, held)
    turn = 0
    while not _settled(edges):
        turn += 1
        if turn > MOST_TURNS:
            raise RuntimeError("components did not settle")
        half = space.stage(_star(edges, large=True), f"{name}-{turn}-large")
        edges = space.stage(_star(half, large=False), f"{name}-{turn}")
        space.drop(f"{name}-{turn}-large", held)
        held = f"{name}-{turn}"
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    found = space.stage(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots), name)
    space.drop(held)
    return found


def edges_of(found: DataFrame) -> DataFrame:
    """Components as edges, to be joined with further ones."""
    return found.select(F.col("node").alias("a"), F.col("component").alias("b"))
