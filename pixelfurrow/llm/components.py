"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelfurrow.llm.common import by_value, discard, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (u, v) that isn't its component's least node, root being that node; written.

    A null end or a loop is no edge. Each step replaces edges by ones to the least neighbour, with minima combined
    before the shuffle; it ends when every edge leads to its component's least node."""
    edges = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = written(edges, "edges"), None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        new = joined.where(F.col("v") != F.col("m")).select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct()
        new = written(new, "edges")
        discard(edges)
        edges, state = new, new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


by_value(__name__)
