"""Connected components of a link table by alternating large and small stars (Kiveris et al. 2014), on DataFrames.

Nothing is collected or broadcast but one count and one checksum a round. A node of many links is no bottleneck: its least neighbour
is found by partial aggregation, and the join that tells its neighbours is a plain equi-join that can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, merged_with


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` (u, v), u > v. Large: each node's larger neighbours go to its least one. Small: its smaller ones do."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else edges
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
    least = least.withColumn("n", F.col("n").bitwiseXOR(F.lit(0).cast("long")))  # dealt out anew: else the join takes the sum's places, which can't be split
    told = merged_with(near, least, near["u"] == least["n"])
    if large:
        out = told.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = told.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): the least node reachable, for each node that has a link in ``links`` (u, v; longs)."""
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    edges, before, k = scratch.save(links, "edges0"), None, 0
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before, k = now, k + 1
        edges = scratch.save(_star(_star(edges, True), False), f"edges{k}")
        scratch.drop(f"edges{k - 1}")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
