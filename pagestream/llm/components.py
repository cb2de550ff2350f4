"""Connected components of a graph of 64-bit ids, by alternating large-star and small-star steps.

Every round is one aggregation and one join by id; hubs are joins that Spark
may split, never groups gathered in a task.  Nothing but a row count reaches
the driver.  Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime as R


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links all (large: larger) neighbours of each node to the least node among the node and its neighbours."""
    both = edges.select(F.col("a").alias("n"), F.col("b").alias("m"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("n"), F.col("a").alias("m")))
    else:  # from each node to its smaller neighbours
        both = both.select(F.greatest("n", "m").alias("n"), F.least("n", "m").alias("m"))
    least = both.groupBy("n").agg(F.min("m").alias("low")).select(F.col("n").alias("k"), F.least("n", "low").alias("low"))
    out = both.join(least, F.col("n") == F.col("k"))
    if large:
        out = out.where("m > n").select(F.col("low").alias("a"), F.col("m").alias("b"))
    else:
        out = out.select(F.col("low").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("low").alias("a"), F.col("k").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) to (node, root): root is the least node of the component. Nodes without edges don't appear."""
    edges = R.stage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        edges = R.stage(_star(_star(edges, True), False), "edges", (edges,))
        # Done when a round changes nothing: all that are linked hang on roots, and the sums of both ends stay.
        now = edges.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).head()
        if now == before:
            hung = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
            return R.stage(hung.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()), "roots", (edges,))
        before = now
