"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from muonloom.session import cut_lineage, drop_table


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is the smallest node reachable.

    Alternates two steps until nothing changes: every node points its larger
    neighbours, then its smaller ones, to its smallest neighbour.  A step is an
    aggregate with map-side minima and a join back, so a node with many links is
    split like any skewed join key; rows never exceed twice the links.  Rounds
    grow with the logarithm of the number of nodes.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b")
    edges = cut_lineage(edges.distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.filter("b > a").join(least.hint("merge"), "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b"))
        own = least.filter("m < a").select("a", F.col("m").alias("b"))
        stars = cut_lineage(large.unionByName(own).distinct())
        least = stars.groupBy("a").agg(F.min("b").alias("m"))
        small = (stars.join(least.hint("merge"), "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b"))
        after = cut_lineage(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        drop_table(edges)
        drop_table(stars)
        edges = after
        # the count and the whole sum of 64-bit hashes tell whether the set of links has changed
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("b").alias("node")).distinct()
    return (edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
            .unionByName(roots.select("node", F.col("node").alias("component"))))
