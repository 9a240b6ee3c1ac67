"""Connected components of a graph held in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stage


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable, for every node of edges (a, b: long).

    Alternates large-star (each node hands its larger neighbours to its smallest one) and small-star (the same for
    smaller ones) until nothing changes: O(log n) rounds of a min by node, which is partially aggregated, and a
    join with one row for each node on one side, which AQE can split.  Each round's edges are a written table.
    """
    now = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    seen = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stage(large, "large")
        least = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("n"))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()
        now = stage(small, "edges")
        state = _state(now)
        if state == seen:
            return _roots(now)
        seen = state


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38)")), F.sum(F.col("b").cast("decimal(38)")), F.bit_xor(F.xxhash64("a", "b"))).first())


def _roots(stars: DataFrame) -> DataFrame:
    """stars: each node but the roots has one edge, to its root."""
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
