"""Connected components by alternating large and small stars; links stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import settled


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every linked node: root is the smallest node it can reach. Null ends are no links.

    Each round turns every neighbourhood into a star around its smallest node; the number of rounds grows with the
    logarithm of the longest path. One row (count and digest of the links) tells when nothing changes any more.
    """
    edge = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v")
    edge = settled(edge.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    print_of = lambda e: e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    before = print_of(edge)
    while before[0]:
        both = edge.unionByName(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edge = settled(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        after = print_of(edge)
        if tuple(after) == tuple(before):
            break
        before = after
    return edge.unionByName(edge.select(F.col("v").alias("u"), F.col("v"))).select(F.col("u").alias("node"), F.col("v").alias("root")).distinct()
