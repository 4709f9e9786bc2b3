"""Connected components of links by alternating stars, as joins and map-side minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quaestor.llm.common import written


def _fingerprint(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("u", "v")
    row = edges.agg(
        F.count(F.lit(1)), F.bit_xor(mixed), F.sum(mixed.cast("decimal(38,0)"))
    ).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """node, root: every node of links (a, b) with the smallest node it reaches.

    Each round links all larger neighbours of a node, then its smaller ones, to its smallest. A node
    with very many links is a minimum with map-side sums and a join that may be split. Edges of a
    round are written, so a lost executor costs one round at most.
    """
    edges = written(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = None
    while before != (now := _fingerprint(edges)):
        before = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # edges to a node's smallest neighbour stay with the smaller node itself
        large = large.filter("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.union(lower.select("u", F.col("m").alias("v"))).distinct())
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
