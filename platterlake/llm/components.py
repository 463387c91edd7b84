"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platterlake.llm.shared import written


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): each node that has a link to another, and the least node it can reach.

    Each round halves the depth of the trees at least, so a few rounds do; a round is two group-bys that keep
    only the least neighbour of a node, and two joins; the table of links that a round has read is deleted after it.
    The centre of a star is one key of the joins: they are plain sort-merge joins, whose skewed partitions adaptive
    execution splits; the group-bys sum in each task first.
    """
    one = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges, before = written(one), None
    while True:
        now = edges.agg(F.count("u"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        before = now
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.union(least.select("u", "m")).distinct(), edges)
