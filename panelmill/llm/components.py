"""Connected components of a graph of long ids, by alternating star contractions.

Each round points the neighbours of a node to the smallest of them, first the larger neighbours, then the smaller;
rounds end when nothing changes, after about the logarithm of a component's diameter.  Minima are combined before the
shuffle and joined back, so a node with very many neighbours is spread over tasks; each round starts from a
written table, and the one before is emptied.  Built-in functions only.

Nulls and edge cases: pairs with a null or of a node with itself are no links; repeated pairs count once; no pairs give
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.session import discard, materialize


def _stars(edges: DataFrame) -> DataFrame:
    """One round on distinct pairs (hi, lo) with lo < hi."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
    low = large.groupBy("hi").agg(F.min("lo").alias("m"))
    small = large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return small.unionByName(low.select("hi", F.col("m").alias("lo"))).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, component) of every node of ``pairs`` (two columns of longs); a component is named by its least node."""
    a, b = (F.col(c) for c in pairs.columns[:2])
    edges = materialize(pairs.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "links")
    before = None
    while True:
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
        before, old = state, edges
        edges = materialize(_stars(edges), "links")
        discard(old)
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
