"""Connected components of an edge table, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchside.llm.textops import materialise


def _to_minimum(pairs: DataFrame) -> DataFrame:
    """(u, v) -> (u, v, m): m is the smallest of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v); the component is its smallest node.

    Alternating stars: every node hands its larger, then its smaller
    neighbours to its smallest one, until nothing changes (about log n
    rounds).  Only minima per node are aggregated and no neighbourhood is
    collected; each round is written to the shared folder.
    """
    def distinct(pairs: DataFrame) -> DataFrame:
        return pairs.where(F.col("u") != F.col("v")).distinct()

    now = materialise(distinct(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))), "cc")
    state = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = distinct(_to_minimum(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")))
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        star = _to_minimum(down)
        small = distinct(star.select(F.col("v").alias("u"), F.col("m").alias("v"))
                         .union(star.select("u", F.col("m").alias("v"))))
        now = materialise(small, "cc")
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(sums) == state:
            break
        state = tuple(sums)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
