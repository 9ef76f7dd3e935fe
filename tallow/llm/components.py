"""Connected components by alternating stars, with every round written to the shared folder."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallow.session import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node it touches."""
    both = edges.union(edges.select("lo", "hi")).toDF("node", "other")
    least = both.groupBy("node").agg(F.min("other").alias("m")).select(
        "node", F.least("node", "m").alias("m")
    )
    hung = both.where(F.col("other") > F.col("node")).join(least, "node")
    return hung.select(F.col("other").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of these."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    joined = edges.join(least, "hi")
    moved = joined.where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.union(least.select("hi", F.col("m").alias("lo"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b, two bigints that differ).

    ``root`` is the smallest node that can be reached; a root has no row of its own.
    Rounds grow with the logarithm of the longest chain. Each is written once, so a lost
    executor repeats a round at most.
    """
    edges = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    edges = stage(edges.where("hi != lo").distinct(), "links")
    before = None
    while True:
        edges = stage(_small_star(_large_star(edges)), "stars")
        mark = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))
        ).first()
        if tuple(mark) == before:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        before = tuple(mark)
