"""Connected components: forests within tasks, contracted by rounds of star operations between them.

Edges are dealt to as many tasks as their number asks for, and each task first merges what it holds into a forest of stars, in
a union of sets of bounded size. What connects stars of different tasks is contracted in rounds: edges are replaced by
edges towards smaller ids until every node has one edge, to the smallest id of its component. Rounds are aggregations and joins on
node ids: no node's neighbours are gathered in one row, so a star with millions of leaves costs no more memory
than a chain. Where one task holds all edges its forest is the result, and no round is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.session import count, materialize

MAX_ROUNDS = 60
#: Edges to a task, so that its union of sets holds at most twice as many nodes, about 200 bytes each.
TASK_EDGES = 500_000


def _stars(parent: dict) -> pd.DataFrame:
    low, high = [], []
    for node in parent:
        root = node
        while parent[root] != root:
            root = parent[root]
        if root != node:
            high.append(node)
            low.append(root)
    return pd.DataFrame({"a": high, "b": low})


def _forest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of a task as stars (a, b): b is the smallest node that a reaches over them."""
    parent: dict = {}
    for pdf in frames:
        for pair in zip(pdf["a"], pdf["b"], strict=True):
            tops = []
            for node in pair:
                path = []
                while (up := parent.setdefault(node, node)) != node:
                    path.append(node)
                    node = up
                for below in path:
                    parent[below] = node
                tops.append(node)
            parent[max(tops)] = min(tops)
        if len(parent) > 2 * TASK_EDGES:  # files of uneven size: its stars go out and it starts anew
            yield _stars(parent)
            parent = {}
    if parent:
        yield _stars(parent)


def _local(edges: DataFrame) -> tuple[DataFrame, int]:
    """The stars of each task, and the number of tasks that the edges ask for."""
    kind, tasks = edges.schema["a"].dataType.simpleString(), max(1, -(-count(edges) // TASK_EDGES))
    return materialize(edges.coalesce(tasks).mapInPandas(_forest, f"a {kind}, b {kind}"), "stars"), tasks


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to the smallest node around it."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them. Here a > b in every edge."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge down at most, and none where others have one down to it."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or (down = 1 and up = 1)").isEmpty()


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Map every node that has an edge to the smallest node it can reach.

    Returns (node, root), one row per node of any edge between two different nodes. Null ends and
    self-loops are ignored, repeated edges count once, an empty edge list gives an empty result.
    Ids may be of any ordered type.
    """
    ends = edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).where(
        F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right))
    )
    cur, tasks = _local(materialize(ends.distinct(), "edges"))
    for _ in range(MAX_ROUNDS):
        if tasks == 1 or _settled(cur):
            break
        cur, tasks = _local(materialize(_small_star(_large_star(cur)), "edges"))
    else:
        raise RuntimeError("connected components did not converge")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).union(cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
