"""Connected components of a graph given as edges, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblume.llm.common import land


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge (a long, b long) to another; root is the smallest node reachable.

    In each round every node points to its smallest neighbour, chains of
    pointers are halved until all end in roots, and the edges are carried over
    to the roots, where loops and repetitions fall away.  Each round at least
    halves the nodes that are left; what a round makes is landed.
    """
    left = land(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                .where("a <> b").distinct(), "edges")
    roots = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pointers = land(both.groupBy(F.col("a").alias("node"))
                        .agg(F.least(F.min("b"), F.first("a")).alias("root")), "pointers")
        while True:
            up = pointers.toDF("root", "_next")
            jumped = land(pointers.join(up, "root").select("node", F.col("_next").alias("root"),
                                                           (F.col("_next") != F.col("root")).alias("moved")), "pointers")
            pointers = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        roots = pointers if roots is None else land(
            roots.toDF("_node", "node").join(pointers, "node", "left")
            .select(F.col("_node").alias("node"), F.coalesce("root", "node").alias("root")), "roots")
        to = pointers.toDF("a", "_a")
        left = land(left.join(to, "a").join(pointers.toDF("b", "_b"), "b")
                    .select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
                    .where("a <> b").distinct(), "edges")
    return left.select(F.col("a").alias("node"), F.col("b").alias("root")) if roots is None else roots
