"""Connected components of an edge table, by rounds of joins and minima.

Every round hangs nodes under the smallest neighbour seen so far and halves the
depth of the resulting trees (the large-star / small-star scheme), so rounds grow
with the logarithm of the longest chain.  Nothing but one count per round comes
to the driver; each round is cut with a reliable checkpoint, so a lost executor
costs at most one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node of its component.

    Loops, repeated and reversed edges are allowed; rows with a null end are ignored.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("up")).distinct()
    pairs = cut(pairs)
    while True:
        # Small star: each node keeps its least upper neighbour; the others meet under that one.
        least = pairs.groupBy("node").agg(F.min("up").alias("root"))
        around = pairs.join(least, "node").select("node", "up", "root")
        small = around.select(F.col("up").alias("x"), F.col("root").alias("y")).union(least.select(F.col("node").alias("x"), F.col("root").alias("y")))
        small = cut(small.filter("x <> y").distinct())
        # Large star: a node's own root passes to everything below it.
        top = small.groupBy("x").agg(F.min("y").alias("top")).withColumnRenamed("x", "mid")
        jumped = small.join(top, small["y"] == top["mid"], "left").select("x", F.coalesce("top", "y").alias("y"))
        new = cut(jumped.select(F.col("x").alias("node"), F.col("y").alias("up")).distinct())
        if new.select(F.count(F.lit(1)), F.sum(F.xxhash64("node", "up").cast("decimal(38,0)"))).first() == pairs.select(F.count(F.lit(1)), F.sum(F.xxhash64("node", "up").cast("decimal(38,0)"))).first():
            break
        pairs = new
    roots = pairs.select("node", F.col("up").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
