"""Connected components by alternating large-star and small-star steps; every step is a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_materialized, materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """For each u, link its larger neighbours (large star) or its smaller ones and itself (small star) to the least of
    u and all its neighbours considered."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = both.join(least, "a")
    linked = joined.filter("b > a" if large else "b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.filter("a <> m").select("a", F.col("m").alias("b")) if not large else None
    out = linked if own is None else linked.unionByName(own)
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, component) for every end of the edges (a, b): component is the least end that is reachable.

    The number of edges never grows, each step ships pairs only, and a hub's edges are pre-aggregated before its
    least neighbour is sought.  Ends when a round changes nothing, told by a count and an order-free checksum.
    """
    now = materialize(edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).filter("a <> b").distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if tuple(mark) == seen or not mark[0]:
            return now.select(F.col("a").alias("v"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("v"), F.col("b").alias("component"))).distinct()
        seen = tuple(mark)
        step = materialize(_stars(_stars(now, True), False), "edges")
        drop_materialized(now)
        now = step
