"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.runtime import discard, materialise


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, label)`` for every node with a link: the smallest node that it reaches.

    Alternates two steps until nothing changes: every node hands its larger neighbours to its smallest one, then
    its smaller ones.  Paths shrink by a constant factor per round, so the number of rounds follows the logarithm
    of the longest path.  Each round is a written table; a sum of hashes tells whether it changed.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges, before = materialise(edges, "links"), None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == before:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")).union(edges.select("v", "v").distinct())
        before = tuple(mark)
        both = edges.union(edges.select("v", "u"))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lowest, "u")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(lowest.select("u", "m")).distinct()
        after = materialise(small, "links")
        discard(edges)
        edges = after
