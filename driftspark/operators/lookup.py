"""Join rows with a table of one row per key when few keys may hold most of the rows.

Adaptive execution splits a skewed join only where both sides are fresh shuffles. A lookup side that
was just aggregated by the key is not, so the rows of its hottest key would meet in one task. Here
hot keys, bounded in number by their definition, are looked up by broadcast, and their rows pass the
shuffle of the others under a salt.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftspark.runtime import col

# A key is hot if it holds more than this share of the rows, so there are fewer than 1 / share of them.
HOT_SHARE = 0.001


def key_counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def join_lookup(
    rows: DataFrame, lookup: DataFrame, keys: Sequence[str], counts: DataFrame, spread_by: str
) -> DataFrame:
    """Left join of ``rows`` with ``lookup`` on ``keys``.

    ``counts`` has ``keys`` and ``n``, the number of rows per key; ``spread_by`` is a column of ``rows``
    that differs among the rows of one key. A null in a key matches nothing, so such rows are only spread.
    """
    keys = list(keys)
    values = [name for name in lookup.columns if name not in keys]
    limit = counts.agg(F.sum("n") * F.lit(HOT_SHARE)).scalar()
    hot = counts.where(F.col("n") > limit).select(*keys)
    packed = lookup.select(*keys, F.struct(*[col(v) for v in values]).alias("_found"))
    hot_found = packed.join(F.broadcast(hot), keys, "left_semi").withColumnRenamed("_found", "_hot_found")
    hot_table = hot.join(hot_found, keys, "left").withColumn("_hot", F.lit(True))
    tagged = rows.join(F.broadcast(hot_table), keys, "left")
    cold = F.col("_hot").isNull()
    known = reduce(Column.__and__, [col(k).isNotNull() for k in keys])
    salted = tagged.select(
        "*",
        *[F.when(cold, col(k)).alias(f"_cold_{k}") for k in keys],
        F.when(cold & known, F.xxhash64(*keys)).otherwise(F.xxhash64(spread_by)).alias("_salt"),
    )
    others = packed.select(
        *[col(k).alias(f"_cold_{k}") for k in keys],
        # A constant here would be folded out of the join, and the salt with it.
        F.xxhash64(*keys).alias("_salt"),
        F.col("_found").alias("_cold_found"),
    )
    joined = salted.join(others, [*[f"_cold_{k}" for k in keys], "_salt"], "left")
    found = F.coalesce("_hot_found", "_cold_found")
    return joined.select(
        *[col(name) for name in rows.columns], *[found.getField(v).alias(v) for v in values]
    )
