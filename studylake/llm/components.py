"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studylake.llm.common import Stored, store


def components(links: DataFrame) -> DataFrame:
    """Components of ``links`` (a, b: long): node, root (the smallest node of its component), nodes with links only.

    Each round points every node to its smallest neighbour or itself, follows the pointers to their ends by doubling,
    renames the links by it and drops those that became loops. A sorted chain of n links is one round of
    log n doublings; what is left of a round are its local minima, which are no neighbours. All
    tables of a round are stored. A node with a third of all links is one group of an aggregate that combines before the shuffle.
    """
    edges = store(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = edges.df.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    roots = store(nodes.select("node", F.col("node").alias("root")))
    while not edges.df.isEmpty():
        both = edges.df.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")).select("e.x", "e.y")
        to = _ends(store(both.groupBy("x").agg(F.least(F.min("x"), F.min("y")).alias("m"))))
        a, b = to.df.select(F.col("x").alias("a"), F.col("m").alias("ma")), to.df.select(F.col("x").alias("b"), F.col("m").alias("mb"))
        renamed = edges.df.join(a, "a").join(b, "b").filter("ma <> mb")
        edges_next = store(renamed.select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).distinct())
        roots_next = store(roots.df.join(to.df.select(F.col("x").alias("root"), "m"), "root", "left").select("node", F.coalesce("m", "root").alias("root")))
        for s in (to, edges, roots):
            s.drop()
        edges, roots = edges_next, roots_next
    edges.drop()
    return roots.df


def _ends(to: Stored) -> Stored:
    """Pointers (x, m) followed to their ends; every m is an x, and an end points to itself."""
    while True:
        further = to.df.select(F.col("x").alias("m"), F.col("m").alias("n"))
        nearer = store(to.df.join(further, "m").select("x", F.col("n").alias("m"), (F.col("n") < F.col("m")).alias("moved")))
        to.drop()
        if nearer.df.filter("moved").isEmpty():
            return nearer
        to = nearer
