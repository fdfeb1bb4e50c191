"""Connected components of a link table, as rounds of joins and aggregates.

Alternates the large-star and small-star steps: every node points its larger
neighbours, then itself and its smaller neighbours, at the smallest node it
knows, until nothing moves and every component is a star around its smallest
node. Each round is written to the shared checkpoint folder. A node with very
many links is only ever aggregated to a minimum and joined back, so no task
holds its neighbourhood.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actlens.llm.common import materialize


def _star(arcs: DataFrame, large: bool) -> DataFrame:
    """arcs (u, v): v is a neighbour of u. Returns links (u, v) with v < u."""
    if large:
        arcs = arcs.union(arcs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = arcs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    near = arcs.join(low, "u")
    if large:
        out = near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = (near.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
               .union(low.select("u", F.col("m").alias("v"))))
    return out.filter("u <> v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, component_id): the smallest node reachable, for
    every node that has a link to another node."""
    arcs = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                       .distinct(), "cc-0")
    state = None
    for i in count(1):
        arcs = materialize(_star(_star(arcs, True), False), f"cc-{i}")
        now = tuple(arcs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return arcs.select(F.col("u").alias("node"), F.col("v").alias("component_id")).union(
                arcs.select(F.col("v").alias("node"), F.col("v").alias("component_id"))).distinct()
        state = now
