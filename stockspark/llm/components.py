"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockspark.llm.common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) edges of whole numbers -> (node, component): the smallest node that each node reaches.

    Every round joins edges with one aggregated row per node, so no neighbourhood is ever
    gathered; rounds grow with the logarithm of the longest chain.  Null ends and loops are
    left out; no edges give no rows.
    """
    links = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = stored(links, "links")
    size = links.count()
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        after = stored(small, "links")
        # both are sets: equal sizes and no link of one missing from the other
        now = after.count()
        same = now == size and after.join(links, ["u", "v"], "left_anti").isEmpty()
        links, size = after, now
        if same:
            break
    roots = links.select(F.col("v").alias("node")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
