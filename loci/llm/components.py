"""Connected components by repeated contraction: every step is a grouped minimum or a join on node numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loci.llm.common import written


def _jumped(parents: DataFrame) -> DataFrame:
    """Parents replaced by roots, doubling the distance each time."""
    while True:
        up = parents.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        step = parents.join(up, "p", "left").select("u", F.coalesce("pp", "p").alias("p"), (F.col("pp") != F.col("p")).alias("moved"))
        step = written(step, "jump")
        if step.where("moved").isEmpty():
            return step.select("u", "p")
        parents = step.select("u", "p")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of an edge table (a, b); the root is some node of its component.

    Each round hangs every node below its smallest neighbour, follows the
    pointers to their roots and contracts the edges; a node's pointer always
    leads to a smaller node, so there are no loops.  The number of rounds grows
    with the logarithm of the node count.  Nulls are not nodes.  No edges: no rows.
    """
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = written(edges, "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("p")).select("u", F.least("u", "p").alias("p"))
        roots = _jumped(written(parents, "parents"))
        left, right = roots.toDF("a", "ra"), roots.toDF("b", "rb")
        smaller = edges.join(left, "a").join(right, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        edges = written(smaller.distinct(), "edges")
        if labels is None:
            labels = roots.toDF("node", "root")
        else:
            labels = labels.join(roots.toDF("root", "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
            labels = written(labels, "labels")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
