"""Connected components by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trencher.operators.storage import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours are linked to the least among them and the node itself.

    ``large``: only the greater neighbours move; else only the smaller ones and the node.
    """
    ends = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = ends.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else ends
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.join(least, "u")
    moved = moved.where(F.col("v") > F.col("u")) if large else moved.where(F.col("v") != F.col("m")).unionByName(least.withColumn("v", F.col("u")))
    return moved.select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def roots(links: DataFrame, stored: Callable[[DataFrame, str], DataFrame] = stored) -> DataFrame:
    """``node, root`` for each node of ``links(a, b)``, both longs: the least node reachable.

    Rounds go on until the edges no longer change; each round is a stored table,
    and no task gathers a node's neighbours.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    state = _state(edges)
    while True:
        edges = stored(_star(stored(_star(edges, True), "large"), False), "edges")
        if (new := _state(edges)) == state:
            break
        state = new
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
