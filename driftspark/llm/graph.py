"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.operators.lookup import join_lookup
from driftspark.runtime import materialize


def _signature(links: DataFrame) -> tuple[int, int]:
    row = links.agg(
        F.count(F.lit(1)), F.coalesce(F.sum((F.xxhash64("a", "b") % 1_000_003).cast("long")), F.lit(0))
    ).first()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """Columns ``node`` and ``component``, the smallest node that links reach, for each node in ``links``.

    ``links`` has two columns of the same orderable type, undirected; self links and repeats are allowed,
    rows with a null are ignored, no links give no rows. A round points each node's larger neighbours at
    its smallest one (large star), then its smaller ones (small star); both only ever look at minima, so
    no neighbour list is built and a hub's rows are salted. The number of rounds is logarithmic in the
    longest path. Only a row count and a checksum reach the driver.
    """
    first, second = links.columns
    pairs = links.select(F.col(first).alias("x"), F.col(second).alias("y"))
    now = materialize(
        pairs.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(),
        "links",
    )
    before = _signature(now)
    while before[0]:
        # Large star: all neighbours of a node, itself included in the minimum.
        both = now.union(now.select("b", "a").toDF("a", "b"))
        grouped = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        lowest = grouped.select("a", F.least("a", "m").alias("m"))
        met = join_lookup(both, lowest, ["a"], grouped.select("a", "n"), "b")
        large = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.where("a <> b").distinct(), "large-star")
        # Small star: only smaller neighbours; the node itself also moves to the smallest.
        grouped = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        met = join_lookup(large, grouped.select("a", "m"), ["a"], grouped.select("a", "n"), "b")
        small = met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialize(small.union(grouped.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        after = _signature(now)
        if after == before:
            break
        before = after
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
