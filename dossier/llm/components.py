"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import forget, written

#: Edges that one task writes, at least, while there are that many.
TASK_EDGES = 50_000


def connected(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (a, b); root is the least node it is joined with.

    Each round points every node at its least neighbour, or at itself if it is
    less, and replaces both ends of every edge by what they point at. Edges
    inside one group vanish; rounds end when none is left, after about as many
    as the logarithm of the longest chain. Minima are summed before the
    shuffle, so a node with very many edges is no burden to one task. Nulls and
    edges from a node to itself are left out.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "edges")
    levels = []
    # Few edges are left to few tasks, or small rounds would cost as many tasks as large ones.
    while count := edges.count():
        tasks = count // TASK_EDGES + 1
        ends = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        near = ends.groupBy(F.col("e.a").alias("node")).agg(F.min("e.b").alias("near"))
        near = written(near.select("node", F.least("node", "near").alias("root")), "roots", tasks)
        levels.append(near)
        one, two = near.toDF("a", "x"), near.toDF("b", "y")
        moved = edges.join(one, "a").select("x", "b").distinct().join(two, "b").where("x <> y")
        moved = moved.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
        last, edges = edges, written(moved, "edges", tasks)
        forget(last)
    if not levels:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = levels[-1]
    for level in reversed(levels[:-1]):
        after = found.toDF("root", "further")
        found = level.join(after, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
    if len(levels) > 1:
        found = written(found, "joined")
        forget(*levels)
    forget(edges)
    return found
