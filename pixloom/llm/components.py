"""Connected components of an edge table, by large-star and small-star steps.

Every step moves a node's neighbours to the smallest one, so the number of
rounds grows with the logarithm of the graph.  Minima are aggregated map-side;
a node with very many neighbours is a skewed join key that adaptive execution
splits.  Each round is checkpointed in the shared folder, and no part of the
graph is collected: the driver sees two sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixloom.llm.common import written


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b): every node that is not the smallest of its component, with the smallest.

    ``edges`` has long columns a and b; loops and repeated edges are allowed.
    """
    here = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        row = here.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if row[0] == 0 or tuple(row) == before:
            return here
        before = tuple(row)
        here = written(_small(_large(here)))
