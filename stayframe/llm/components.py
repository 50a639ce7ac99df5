"""Connected components of a link table, with all state in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayframe.llm.stored import stored


def connected(links: DataFrame, left: str, right: str) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node with a link to another.

    Alternates two steps until nothing changes: every node hands its smallest neighbour to all larger neighbours, then
    to all smaller ones. Links only ever point to smaller nodes in the end, one per node. Each round is written out, so
    the lineage stays short; rounds grow with the logarithm of the longest path. A node that very many link to is spread
    by aggregating before the shuffle: minima, never lists of neighbours, are gathered.
    """
    edges = links.where(F.col(left) != F.col(right)).select(
        F.greatest(left, right).alias("u"), F.least(left, right).alias("v")
    )
    edges = stored(edges.distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written out, so that a node with very many links is no obstacle: the join can split its rows.
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
        # Larger neighbours take the least of the node's neighbourhood.
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.where("m < u").select("u", F.col("m").alias("v")))
            .where("u > v").distinct()
        )
        large = stored(large, "links")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = (
            large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .where("u > v").distinct()
        )
        edges = stored(small, "links")
        state = edges.agg(
            F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("h")
        ).first()
        if (state["n"], state["h"]) == before:
            break
        before = (state["n"], state["h"])
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)
