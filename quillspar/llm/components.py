"""Connected components of a link table, wholly on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Label the nodes of ``links`` (two long columns) by component: rows (node, root).

    Randomised contraction: in each round every node hooks to the neighbour (or itself) that is first in an
    order drawn anew from a hash, and links are rewritten to the hooked ends. Each round removes a constant share
    of the nodes in expectation, so chains take a logarithmic number of rounds. Rounds are checkpointed.
    Nothing is collected; a node with many neighbours costs one partially aggregated minimum.

    An empty table gives an empty result; loops and repeated links do no harm; links with a null end are left out.
    """
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = cut(edges)
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct().withColumn("root", F.col("node"))
    edges = edges.where("a <> b")
    turn = 0
    while not edges.isEmpty():
        order = lambda c, t=turn: F.struct(F.xxhash64(F.lit(t), F.col(c)).alias("h"), F.col(c).alias("x"))
        hooked = both(edges).groupBy("a").agg(F.min(order("b")).alias("m")).select("a", F.least("m", order("a"))["x"].alias("to"))
        hooked = cut(hooked)
        labels = cut(labels.join(hooked.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        left = edges.join(hooked, "a").select("b", F.col("to").alias("a"))
        done = left.join(hooked.withColumnRenamed("a", "b"), "b").select("a", F.col("to").alias("b")).where("a <> b")
        edges = cut(done.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        turn += 1
    return labels
