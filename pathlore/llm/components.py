"""Connected components of a large edge table by alternating star operations, with the lineage cut after each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathlore.llm.common import stored


EDGES_A_TASK = 50_000  # a round's edges are stored in no more partitions than that asks for


def _shape(edges: DataFrame) -> tuple[int, bool]:
    """Number of edges, and whether they are stars: no larger end has a second edge."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.count(F.lit(1)).alias("n"))
    rows, mixed = nodes.agg(F.sum("up"), F.max((F.col("up") > 0) & (F.col("n") > 1))).first()
    return rows or 0, not mixed


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that can be reached, for every node of the edges (a, b); NULL ends are no edges.

    Large stars hang every larger neighbour onto the least neighbour, small stars every smaller one. A hub is one key of
    a partial minimum and of a join that Spark may split, never a group in one task. No round makes edges more, so each is
    stored in as many partitions as its edges fill; edges that are stars already, as an earlier result, take no round.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(edges)
    while not (shape := _shape(edges))[1]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(floor, "a")
        hung = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        hung = hung.unionByName(floor.select("a", F.col("m").alias("b"))).distinct()
        edges = stored(hung.coalesce(shape[0] // EDGES_A_TASK + 1))
    own = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(own.withColumn("label", F.col("node")))
