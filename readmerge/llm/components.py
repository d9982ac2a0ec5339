"""Connected components of a link table by alternating star contraction; each round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import scratch


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that ``links`` (a, b: long) names; root is the least node of its component.

    Large star: neighbours above a node move to the least neighbour.  Small star: those below do.  Rounds end when
    the edges no longer change.  Sums of least neighbours are grouped before any join, so a hub only meets its own edges.
    The result reads the edges of the last round, which ``scratch.drop`` takes away.
    """
    edges = scratch.materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            out = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
            out.scratch_path = edges.scratch_path
            return out
        mark = now
        near = _both(edges)
        least = near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = near.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = scratch.materialize(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("u", "m")).where("a <> b")
        after = scratch.materialize(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "small-star")
        scratch.drop(edges)
        scratch.drop(large)
        edges = after
