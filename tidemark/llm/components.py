"""Connected components of an edge table, by alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import counted, written


def components(edges: DataFrame) -> DataFrame:
    """node and label, the smallest node of its component, for every linked node.

    ``edges`` has columns a and b, in any direction, loops and repeats allowed. Large
    and small star rounds alternate: each node's neighbours are hung on the smallest of
    them, which never adds edges and ends in stars after about the logarithm of the
    longest path. A round joins the edges with one minimum for each node; the table of
    minima is written and counted, and sent to all tasks only if small, so a node with
    very many neighbours is split as any skewed side of a join is. Every round is
    written to the shared folder and reads the one before.
    """
    half = edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    half = written(half.distinct(), "component-edges")
    state = _state(half)
    while True:
        half = written(_small_star(written(_large_star(half), "component-large")), "component-edges")
        new = _state(half)
        if new == state:
            return half.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
                half.select(F.col("b").alias("node"), F.col("b").alias("label"))
            ).distinct()
        state = new


def _state(half: DataFrame) -> tuple:
    """Count and an order-free digest of the edges; equal in two rounds at the end."""
    return tuple(
        half.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    )


def _large_star(half: DataFrame) -> DataFrame:
    """Each neighbour above a node is hung on the smallest node around it."""
    both = half.select(F.explode(F.array(
        F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
        F.struct(F.col("b").alias("u"), F.col("a").alias("v")),
    )).alias("e")).select("e.*")
    least = counted(
        both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "component-minima"
    )
    return (
        both.where("v > u").join(least, "u")
        .select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    )


def _small_star(half: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are hung on the smallest of those."""
    least = counted(half.groupBy("a").agg(F.min("b").alias("m")), "component-minima")
    hung = half.join(least, "a").select(F.explode(F.array(
        F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
        F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
    )).alias("e")).select("e.*")
    return hung.where("a <> b").distinct()
