"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import drop_staged, staged


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (a, b); the component is its smallest node.

    Each step joins the links with the smallest neighbour of a node, which is
    aggregated before the shuffle, so a node with most of the links is no
    bottleneck, and writes as many links as it reads. Steps end once the links
    are stars: every larger end is in one link, and no smaller end in another link.
    """
    edges = staged(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("links"), F.lit(0).alias("hub")).union(
            edges.select(F.col("v").alias("node"), F.lit(0).alias("links"), F.lit(1).alias("hub"))
        )
        ends = ends.groupBy("node").agg(F.sum("links").alias("links"), F.max("hub").alias("hub"))
        if not ends.filter(F.col("links") + F.col("hub") > 1).agg(F.count(F.lit(1))).first()[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
            ).distinct()
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = staged(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = staged(small.filter("u <> v").distinct(), "links")
        drop_staged(edges)
        drop_staged(large)
        edges = after
