"""Exact frequent values by a sketch that nominates candidates and a recount of these.

The sketch (Spark's frequent-items sketch of 64-bit hashes) keeps a bounded number of counters per column and merges,
so what is shuffled follows the number of tasks and not that of distinct values. It knows by how much it may be wrong.
A recount of the candidates gives their exact counts; if the k-th of them exceeds what any other value can have, or if
the candidates are all values there are, the answer is certified. Where it is not, as in columns whose values hardly
repeat, ``top_values`` counts all values of that column instead.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftspark.runtime import materialize

# Values that a sketch tracks per column; an entry takes 16 bytes.
TRACKED = 4096
# Sketches of a column that are merged by one task before all are.
MERGES = 64

SCHEMA = "column_name STRING, value STRING, n BIGINT, position INT"


@dataclass(frozen=True)
class Nominees:
    """Hashes of one column to recount; no value outside of them occurs more than ``bound`` times."""

    column_name: str
    n: int
    hashes: list[int]
    bound: int
    hopeful: bool


def _error(head: bytes | None, n: int) -> int | None:
    """The most that the sketch may be off, from the head of its stored form: flags, active items, weight, offset.

    None if the head does not say what it should, such as the number of values that went in.
    """
    if head is None or len(head) < 32:
        return None
    _, weight, offset = struct.unpack("<qqq", head[8:32])
    return offset if weight == n and 0 <= offset <= n else None


def _nominees(column_name: str, n: int, head: bytes | None, found: Sequence[tuple[int, int]], k: int, tracked: int) -> Nominees:
    """Candidates of one sketch, given as (hash, most that it can occur) in falling order.

    An estimate is at most ``error`` above the true count of a hash, so a value below the k-th estimate by more than
    that need not be recounted. A hash that the sketch left out occurs at most twice the error: it was either dropped,
    or tracked with a sure count no larger than the error.
    """
    error = _error(head, n)
    if error is None:
        return Nominees(column_name, n, [], n, False)
    floor = found[k - 1][1] - error if len(found) >= k and error else 0
    hashes = [h for h, most in found if most >= floor]
    left = [most for _, most in found[len(hashes):]]
    bound = max([2 * error, *left[:1], *([found[-1][1]] if len(found) == tracked else [])])
    # With fewer than k candidates and an error, or a k-th estimate below the bound, a recount cannot certify.
    hopeful = found[k - 1][1] > bound if len(found) >= k and bound else error == 0
    return Nominees(column_name, n, hashes, bound, hopeful)


def sketches(values: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """One row per column of ``values`` (``column_name, value``): count of values, head of the sketch, its items.

    Sketches are made in the tasks and merged in two steps, so no task merges those of all others.
    """
    part = F.pmod(F.spark_partition_id(), F.lit(MERGES)).alias("part")
    hashed = values.select("column_name", F.xxhash64("value").alias("hash"), part)
    parts = hashed.groupBy("column_name", "part").agg(
        F.expr(f"approx_top_k_accumulate(hash, {tracked})").alias("sketch"), F.count(F.lit(1)).alias("n")
    )
    merged = parts.groupBy("column_name").agg(
        F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"), F.sum("n").alias("n")
    )
    return merged.select(
        "column_name", "n", F.substring("sketch.sketch", 1, 32).alias("head"),
        F.expr(f"approx_top_k_estimate(sketch, {tracked})").alias("items"),
    )


def _keyed(values: DataFrame) -> DataFrame:
    return values.withColumn("digest", F.unhex(F.sha2("value", 256)))


def candidate_counts(values: DataFrame, nominees: Sequence[Nominees]) -> DataFrame:
    """Exact counts of the values with a nominated hash: ``column_name, digest, n, value``.

    The hashes are at most as many as a sketch tracks, for each column, so they are broadcast; other rows end there.
    """
    rows = [(x.column_name, h) for x in nominees for h in x.hashes]
    wanted = values.sparkSession.createDataFrame(rows, "column_name string, hash long")
    hits = values.withColumn("hash", F.xxhash64("value")).join(F.broadcast(wanted), ["column_name", "hash"], "left_semi")
    return _keyed(hits.drop("hash")).groupBy("column_name", "digest").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("value")
    )


def _ranked(counts: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), "digest")
    return counts.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def _certified(counts: DataFrame, nominees: Sequence[Nominees], k: int) -> list[str]:
    """Columns whose k most frequent values are surely among those counted."""
    kth = F.get(F.sort_array(F.collect_list("n"), asc=False), k - 1)
    seen = {
        row["column_name"]: row
        for row in counts.groupBy("column_name").agg(F.sum("n").alias("n"), kth.alias("kth")).collect()
    }
    return [
        x.column_name
        for x in nominees
        if (row := seen.get(x.column_name)) and (row["n"] == x.n or (row["kth"] or 0) > x.bound)
    ]


def counted_fully(values: DataFrame, k: int) -> DataFrame:
    """The same answer from the counts of all distinct values.

    Values travel as their digest and are counted before the shuffle, and ranks come with a per-partition limit, so
    neither a value nor a column that holds most rows reaches one task whole. The text is looked up for the winners.
    """
    keyed = _keyed(values)
    key = ["column_name", "digest"]
    winners = _ranked(keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), k)
    # At most ``k`` winners per column, so the lookup is a bounded broadcast.
    whole = (
        keyed.join(F.broadcast(winners.select(*key)), key, "left_semi").groupBy(*key).agg(F.min("value").alias("value"))
    )
    return winners.join(whole, key).select("column_name", "value", "n", "position")


def top_values(values: DataFrame, k: int, tracked: int = TRACKED) -> DataFrame:
    """The ``k`` most frequent values of each column of ``values`` (``column_name, value``, without nulls):
    ``column_name, value, n, position``. Ties go to the smaller SHA-256 digest of the value.

    Runs the sketch when called, and the recount where it has to be certified; the driver sees hashes and counts only.
    A column whose distinct values all fit in the sketch needs no certificate. Columns without any value give no row.
    """
    if k < 1 or k > tracked:
        raise ValueError(f"k must be from 1 to {tracked}")
    nominees = [
        _nominees(row["column_name"], row["n"], row["head"], [(x["item"], x["count"]) for x in row["items"]], k, tracked)
        for row in sketches(values, tracked).collect()
    ]
    parts, done = [], set()
    # Nothing but the candidates occurs in these columns.
    known = [x for x in nominees if x.hopeful and not x.bound]
    if known:
        parts.append(_ranked(candidate_counts(values, known), k))
        done.update(x.column_name for x in known)
    hopeful = [x for x in nominees if x.hopeful and x.bound]
    if hopeful:
        counts = materialize(candidate_counts(values, hopeful), "frequent")
        certified = _certified(counts, hopeful, k)
        parts.append(_ranked(counts.where(F.col("column_name").isin(certified)), k))
        done.update(certified)
    rest = [x.column_name for x in nominees if x.column_name not in done]
    if rest:
        parts.append(counted_fully(values.where(F.col("column_name").isin(rest)), k))
    if not parts:
        return values.sparkSession.createDataFrame([], SCHEMA)
    return reduce(DataFrame.unionByName, [part.select("column_name", "value", "n", "position") for part in parts])
