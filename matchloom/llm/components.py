"""Connected components by alternating large-star and small-star steps.

A step deals the edges by node and takes the smallest neighbour over a window, which spills
where a node has many neighbours.  One iteration is two shuffles and one staged table, all of
it DataFrame operations; a lost executor costs one read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, unstage


def large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node with the smallest of the node and its neighbours."""
    both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
    least = F.least("a", F.min("b").over(Window.partitionBy("a")))
    return both.withColumn("m", least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"), (F.col("m") != F.col("a")).alias("changed"))


def small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours with the smallest of them; ``a`` is the larger end."""
    once = edges.repartition("a").groupBy("a", "b").agg(F.max("changed").alias("changed")).withColumn("m", F.min("b").over(Window.partitionBy("a")))
    more = F.col("b") != F.col("m")
    return once.select(F.when(more, F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b"), (more | F.col("changed")).alias("changed"))


def components(pairs: DataFrame, tag: str = "cc") -> DataFrame:
    """Label each node of ``pairs`` (a, b: long) with the smallest node it reaches: rows (node, label).

    Nodes that are their own smallest are rows too; nodes without pairs are not.
    """
    edges = pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    table = staged(small_star(large_star(edges)), tag)
    while not table.where("changed").isEmpty():
        after = staged(small_star(large_star(table.select("a", "b"))), tag)
        unstage(table)
        table = after
    own = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("label")), F.struct(F.col("b").alias("node"), F.col("b").alias("label")))).alias("x")
    return table.select(own).select("x.node", "x.label").distinct()
