"""Frontiers, breadth-first levels and topological levels over edges (src, dst)."""
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.graph import kept


def first_places(rows: DataFrame) -> DataFrame:
    """value, first: the least pos of each value."""
    return rows.groupBy("value").agg(F.min("pos").alias("first"))


def one_hop(edges: DataFrame, frontier: DataFrame, direction: str = "forward") -> DataFrame:
    """node: the neighbours of the frontier(node) along the edges or against them."""
    ends = {"forward": ("src", "dst"), "backward": ("dst", "src")}
    if direction not in ends:
        raise ValueError(f"no direction {direction!r}")
    a, b = ends[direction]
    return edges.join(frontier.select(F.col("node").alias(a)), a, "left_semi").select(F.col(b).alias("node")).distinct()


def bfs(edges: DataFrame, source: DataFrame) -> DataFrame:
    """node, level of all nodes that the source(node) reaches."""
    level, k = source.select("node", F.lit(0).alias("level")).distinct(), 0
    seen = kept(level)
    level = seen
    while not level.isEmpty():
        k += 1
        level = kept(one_hop(edges, level).join(seen, "node", "left_anti").select("node", F.lit(k).alias("level")))
        seen = seen.unionByName(level)
    return seen


def expansion_levels(edges: DataFrame, source: DataFrame, most: int | None = None) -> DataFrame:
    """node, level of a walk over edges(pos, src, dst) in the order of pos: in each round every visited node
    takes its first edge that is left, the targets form the next level (again, if they were in one before),
    and the edges from visited nodes to them are used up. The walk ends when all nodes are visited, a
    round finds no edge, or after `most` rounds."""
    visited = kept(source.select("node").distinct())
    out, k = [visited.select("node", F.lit(0).alias("level"))], 0
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).unionByName(source.select("node")).distinct()
    left = edges.select("pos", "src", "dst")
    while k != most and not nodes.join(visited, "node", "left_anti").isEmpty():
        k += 1
        open_edges = left.join(visited.select(F.col("node").alias("src")), "src", "left_semi")
        first = open_edges.groupBy("src").agg(F.min_by("dst", "pos").alias("node"))
        targets = kept(first.select("node").distinct())
        if targets.isEmpty():
            break
        out.append(targets.select("node", F.lit(k).alias("level")))
        used = open_edges.join(targets.select(F.col("node").alias("dst")), "dst", "left_semi").select("pos")
        left = kept(left.join(used, "pos", "left_anti"))
        visited = kept(visited.unionByName(targets).distinct())
    return reduce(DataFrame.unionByName, out)


def topological_levels(edges: DataFrame, source: DataFrame) -> DataFrame:
    """node, level: a node follows once all its predecessors have; nodes on cycles or that nothing
    leads to are left out, and the walk ends when a round adds nothing. Each round takes the edges of the
    last level off the in-degrees of the nodes that are left."""
    done = kept(source.select("node", F.lit(0).alias("level")).distinct())
    edges = edges.select("src", "dst").distinct()
    left = kept(edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n")).join(done, "node", "left_anti"))
    out, level, k = [done], done, 0
    while not level.isEmpty():
        k += 1
        taken = edges.join(level.select(F.col("node").alias("src")), "src", "left_semi").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("m"))
        left = kept(left.join(taken, "node", "left").select("node", (F.col("n") - F.coalesce("m", F.lit(0))).alias("n")))
        level = left.filter("n = 0").select("node", F.lit(k).alias("level"))
        left = left.filter("n > 0")
        out.append(level)
    return reduce(DataFrame.unionByName, out)
