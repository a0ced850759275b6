"""Connected components of an edge table by rounds of joins; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadtrace.llm.storage import join_hot, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b): root is the least node of its component.

    In each round a node hands its least neighbour to all its neighbours, and the
    edges become links to least nodes; it ends when all of them are stars, after a
    number of rounds that grows with the logarithm of the longest path. A node with
    very many neighbours is a hot key of the join and is handled as such.
    """

    def tidy(pairs: DataFrame) -> DataFrame:
        return materialize(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    edges = tidy(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        around = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"), F.count_if(F.col("b") < F.col("a")).alias("lesser"))
        least = materialize(around.withColumn("m", F.least("a", "m")), "least")
        # stars: a node with a lesser neighbour has no other
        total, open_ = least.agg(F.sum("n"), F.count_if((F.col("lesser") > 0) & (F.col("n") > 1))).head()
        if not open_:
            return least.select(F.col("a").alias("node"), F.col("m").alias("root"))
        handed = join_hot(both, least, "a", "n", total, ["m"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = tidy(handed.unionByName(least.select("a", F.col("m").alias("b"))))
