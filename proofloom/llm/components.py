"""Connected components by alternating large-star and small-star steps; every table stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofloom.llm.common import drop_staged, staged


def _mark(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """links: two bigint columns. Returns node, root: root is the smallest node reachable. Only linked nodes appear."""
    a, b = (F.col(c) for c in links.columns)
    edges = staged(links.filter(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "links")
    mark = _mark(edges)
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).filter("hi != lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.explode(F.array("hi", "lo")).alias("hi"), F.col("m").alias("lo")).filter("hi != lo").distinct()
        after = staged(small, "links")
        new = _mark(after)
        drop_staged(edges)
        edges = after
        if new == mark:
            break
        mark = new
    nodes = edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return nodes.union(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
