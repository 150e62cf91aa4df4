"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is the smallest node of its component.

    Each round first hangs all larger neighbours of a node, then the node and its smaller
    neighbours, onto the smallest node known; the number of rounds grows with the logarithm of the
    longest path. A node's neighbours are only ever reduced to their minimum, never collected, and
    each round is written, so that hot nodes and lost executors do no harm.
    """
    now = written(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    before = None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.col("n")).alias("m"))
        large = both.join(least, F.col("a") == F.col("n")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.filter("a <> b").distinct().select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        down = written(down, "stars")
        least = down.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = down.join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("n", "m"))
        now = written(small.filter("a <> b").distinct(), "edges")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
    roots = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return roots.union(now.select(F.col("b"), F.col("b")).distinct())
