"""Connected components of an edge table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b bigint): the smallest node reachable.

    Every round sends each label to its smallest neighbour and rewrites the edges between labels,
    which shrink until none is left.  Labels stay connected exactly if their nodes are: an edge
    (u, w) with w the choice of u becomes (w, choice of w).  Each round is written to the shared
    folder, so a lost executor costs one round.
    """
    both = lambda e: e.select("a", "b").union(e.select("b", "a")).toDF("a", "b")
    edges = saved(edges.select("a", "b").filter("a != b").distinct(), "cc-edges")
    labels = both(edges).select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))
    while not edges.isEmpty():
        choice = both(edges).groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("to"))
        choice = saved(choice.select(F.col("a").alias("was"), "to"), "cc-choice")
        labels = labels.join(choice, labels["component"] == choice["was"], "left")
        labels = saved(labels.select("node", F.coalesce("to", "component").alias("component")), "cc-labels")
        one, two = choice.toDF("a", "x"), choice.toDF("b", "y")
        moved = edges.join(one, "a").join(two, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        edges = saved(moved.filter("a != b").distinct(), "cc-edges")
    return labels
