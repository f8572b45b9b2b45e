"""Connected components of a link table by alternating large and small stars.

Nothing is gathered: every round is two shuffles over the links, written to the shared
folder.  A node with very many links is handled by the partial minimum and a join that
Spark may split, never by listing its neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casefile.llm.common import materialize


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """Links between integer nodes -> (node, root): root is the smallest node reachable.

    Only nodes with a link to another node appear.  Each round at least halves the
    distance of a node to its root, so chains take a number of rounds that grows with
    the logarithm of their length.
    """
    edges = links.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a != b")
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                        "links")
    seen = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or (state["n"], state["h"]) == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = (state["n"], state["h"])
        edges = materialize(_small_star(_large_star(edges).distinct()).distinct(), "links")
