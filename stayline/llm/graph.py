"""Connected components of an edge table by alternating large and small stars,
with every round written to the shared folder; nothing reaches the driver but
whether another round is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.session import cut_lineage


def own_exchange(df: DataFrame, key: str) -> DataFrame:
    """``df`` with ``key`` as an expression of itself: the planner then knows no
    partitioning of an aggregated side and joins it through an exchange of its
    own.  Only a join of two such exchanges has its skewed keys split."""
    return df.withColumn(key, F.col(key).bitwiseXOR(F.lit(0)))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a, b), a > b.  Large star: every larger neighbour of a node is
    tied to the smallest node around; small star: every smaller one is."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = both.where("b > a").join(own_exchange(low, "a"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return out.where("a > b")
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    out = edges.join(own_exchange(low, "a"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
        low.select("a", F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest reachable node, for every node with an edge to
    a smaller one in its component (the smallest nodes themselves are left out).
    ``edges`` has columns a > b and is written already.  Hot nodes: the minimum is combined before the
    shuffle, and the join back splits skewed keys.  It ends when the edges are
    stars: no node has two smaller neighbours, none is on both sides."""
    now = edges.select("a", "b")  # repeated edges go in the first star
    while True:
        now = cut_lineage(_star(_star(now, True), False))
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(
            now.select(F.col("b").alias("node"), F.lit(0).alias("up")))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
        if ends.where("up > 1 OR (up = 1 AND least = 0)").isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
